import pytest

from calembour.llm.answer_defects import defect, defective_answers, tiled

Q = "Why did Pru Vato bring a bank to the well-known harbour? Because the knight was already taken!"
GOOD = "Pourquoi Pru Vato cherche-t-il « banque » au port ? Parce que le chevalier a déjà pris un vélo !"


@pytest.mark.parametrize(
    ("field", "answer", "want"),
    [
        *[(f, a, "empty") for f in ("pun_word", "pun_type", "generated_pun") for a in (None, "", " \n", "N/A", "null", "ERROR", "...", "?", "[]", '""', "-", "None.")],
        *[(f, a, "refusal") for f in ("pun_word", "pun_type", "generated_pun") for a in ("I'm sorry, but I can't help with this request.", "Désolé, il m'est impossible de répondre.", "As a language model, I cannot do that.", "Es tut mir leid, ich kann das nicht beantworten.", "Lo siento, no puedo ayudar.", "unable to tell", "cannot be determined")],
        *[(f, a, "copy") for f in ("pun_word", "pun_type", "generated_pun") for a in (Q, Q.upper(), Q.replace(" Pru", ""), f"Here it is: {Q}")],
        ("pun_word", "bank", None), ("pun_word", " Bank. ", None), ("pun_word", "well-known", None),
        ("pun_word", "ban", "truncated"), ("pun_word", "banque", "wrong_language"), ("pun_word", "chevalier", "wrong_language"),
        ("pun_type", "homographic", None), ("pun_type", " HOMOPHONIC. ", None),
        ("pun_type", "homogra", "truncated"), ("pun_type", "homographique", "wrong_language"), ("pun_type", "omofonico", "wrong_language"),
        ("generated_pun", GOOD, None), ("generated_pun", GOOD + " (sourire)", None), ("generated_pun", f"« {GOOD} »", None), ("generated_pun", GOOD[:-2] + ", et je ne peux pas m'en empêcher.", None),
        ("generated_pun", "Désolé, Pru Vato a échangé le vélo contre une banque au port.", None),
        ("generated_pun", GOOD[:60], "truncated"), ("generated_pun", "Le chevalier dit que « la banque", "truncated"), ("generated_pun", "Le mot (qui est dans la banque.", "truncated"), ("generated_pun", "```\nLe mot est dans la banque.", "truncated"),
        ("generated_pun", "The baker sold a cheap fan to the harpist and called it a fair trade.", "wrong_language"),
        ("generated_pun", "Warum lacht der Bäcker im Keller über das Mehl? Weil der Witz zu tief war.", "wrong_language"),
        ("generated_pun", "Почему рыцарь пошёл в банк? Потому что он хотел сесть.", "wrong_language"),
    ],
)
def test_defects(field, answer, want):
    assert defect(field, answer, Q) == want


def brute_tiles(a, b, least=2):
    """Longest common run first, over and over."""
    a, b, total = list(a), list(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] is not None and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        total += n
        a[i : i + n] = [None] * n
        b[j : j + n] = [object()] * n


@pytest.mark.parametrize("seed", range(30))
def test_tiling_covers_as_much_as_the_plain_algorithm(seed):
    import random

    rng = random.Random(seed)
    a = [rng.choice("abcdef") for _ in range(rng.randint(2, 18))]
    b = [rng.choice("abcdef") for _ in range(rng.randint(2, 18))]
    assert abs(tiled(a, b) - brute_tiles(a, b)) <= 2  # equal runs may be laid in another order


def test_long_answers_end(spark):
    assert defect("generated_pun", "le mot et la banque " * 20_000, "word " * 5_000) == "truncated"


def test_table(spark):
    df = spark.createDataFrame([(1, "m", Q, "bank", "homophonic", GOOD), (2, None, None, None, "homo", "x"), (2, None, None, None, "homo", "x")], "pair_id bigint, k string, text_clean string, pun_word string, pun_type string, generated_pun string")
    got = sorted(tuple(r) for r in defective_answers(df).collect())
    assert got.count((2, "pun_word", "empty")) == 2 and got.count((2, "pun_type", "truncated")) == 2 and not any(r[0] == 1 for r in got)
    assert defective_answers(df.limit(0)).count() == 0
