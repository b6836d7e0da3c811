"""Long texts that say the same over and over: no operator may search them again from every character."""

import pytest

from calembour.llm import answer_defects, entity_matching, lookalikes, text_quality

SHAPES = ["a", "a ", '"', "(", "a'", "\n", "<", "- a\n", "«a ", "ha ", "a.", "( ) ", "](", "**", "<a>", "1. ", "| a | b |\n", "sorry ", "can't ", "​", "á"]


@pytest.mark.parametrize("shape", SHAPES)
def test_long_texts(shape):
    text = shape * (60_000 // len(shape))
    for field in answer_defects.CHECKS:
        answer_defects.defect(field, text, "some question with words")
    assert answer_defects.defect("generated_pun", text, text) in ("empty", "refusal", "copy", "wrong_language", "truncated", None)
    assert text_quality.kind_of(text, text_quality.statistics(text, frozenset())) in ("prose", "list", "table", "junk", None)
    assert lookalikes.Scores({}).canonical(text) is not None
    entity_matching.words_of(text)


def test_short_runs_cover_what_tiles_cover():
    a, b = ["ha"] * 900 + ["ho"] * 4, ["ha"] * 1000
    assert answer_defects.covered_by_short_runs(a, b, 2) == 900 == answer_defects.tiled(a, b)
    assert answer_defects.covered_by_short_runs(["x", "y", "z"], ["y", "z", "x", "y"], 2) == 3


def test_long_texts_are_tiled_like_short_ones():
    """``b c`` is no run of the answer once ``a b`` has taken its ``b``, however often both are said."""
    a, b = "a b x b c".split(), "a b c y".split()
    for times in (1, 20, 900):
        assert answer_defects.tiled(a * times, b * times) == 2 * times
        assert not answer_defects.is_copy(b * times, a * times)


def test_many_lengths_of_runs():
    a = [x for n in range(2, 120) for x in (*["a"] * n, f"b{n}")]
    b = [x for n in range(119, 1, -1) for x in (*["a"] * n, f"c{n}")]
    assert answer_defects.tiled(a, b) == sum(range(2, 120))
