"""Schemas of the text stages, as DDL."""

TRANSLATION_EN = "id_en string, en string"
TRANSLATION_FR = "id_en string, text_fr string"
CLEANED_EN = "id_en string, text_clean string"
LOCATION_MANUAL = "id_en string, manual_location string, manual_type string, manual_alternative string"
LOCATION_FR_INPUT = "id string, text string"
LOCATION_FR_QRELS = "id string, location string"
IDENTIFIED = "pun_word string, pun_type string, first_meaning array<string>, second_meaning array<string>, first_context array<string>, second_context array<string>"
TRANSLATED = "pun_word_fr string, first_meaning_fr array<string>, second_meaning_fr array<string>, first_context_fr array<string>, second_context_fr array<string>"
SIMILARITY = (
    "first_similarity_en double, second_similarity_en double, first_similarity_fr double, second_similarity_fr double, first_difference double, second_difference double"
)
HOMONYM = "is_homonym int, first_meaning_overlap int, second_meaning_overlap int"
GENERATED = "generated_pun string"
JUDGED = "is_pun int"
VOCABULARY = "word string, ipa string"
EMBEDDING = "vec_id bigint, word string, embedding array<float>"
ANNOTATIONS = "`Is a Joke?` array<int>, `Funniness (1-5)` array<int>, `Understand the text?` array<int>, `Joke keywords` array<array<string>>"
