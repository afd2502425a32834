import random

import pytest

from quire.functions.pieces import estimate
from quire.llm import splitting


def pieces(text, most, lap):
    out = splitting.cut(text, most, lap)
    assert "".join(text[b:e] for _, b, e in out) == text  # bodies join to the text
    for n, (s, b, e) in enumerate(out):
        assert estimate(text[s:e]) <= most
        assert s <= b and estimate(text[s:b]) <= lap and (n > 0 or s == b == 0)
    return out


@pytest.mark.parametrize("most,lap", [(40, 8), (40, 0), (100, 10), (7, 3)])
def test_round_trip_and_limits(most, lap):
    rng = random.Random(most)
    for _ in range(60):
        words = [rng.choice(["word", "a", "sentence.", "end!\n\n", "日本語", "x" * rng.randint(1, 90), "😀", "- item\n"]) for _ in range(rng.randint(1, 200))]
        pieces(" ".join(words), most, lap)


def test_cuts_at_paragraphs_and_overlaps_words():
    text = "\n\n".join("This paragraph number holds exactly some words for us." for _ in range(8))
    out = pieces(text, 40, 8)
    assert all(text[b - 2 : b] == "\n\n" for _, b, _ in out[1:])
    assert all(0 < estimate(text[s:b]) <= 8 for s, b, _ in out[1:])


def test_no_spaces_and_small_texts():
    assert len(pieces("x" * 1000, 40, 0)) == 7
    assert splitting.cut("short", 40, 8) == [(0, 0, 5)]
    with pytest.raises(ValueError):
        splitting.cut("日本語", 0, 0)


def test_spark(spark):
    long = "Some sentence here. " * 200
    rows = [(1, "text", long, 3), (2, "text", "short", 900), (3, "text", None, 1), (4, "odd", long, 1), (5, None, long, 1), (6, "table", long, None), (7, "text", "", 1), (8, "text", "x" * 300_000, 1)]
    chunks = spark.createDataFrame([(*r, "p", 9) for r in rows], "id long, kind string, text string, token_count int, piece string, max_tokens int").drop("max_tokens")
    limits = spark.createDataFrame([("text", "estimate", 400, 40), ("text", "estimate", 400, 40), ("table", "estimate", 400, 0), ("container", "wordpunct", 1024, 0)], "item string, unit string, max_tokens int, overlap_tokens int")
    got = splitting.split_oversized(chunks, limits).collect()
    assert {r.id for r in got} == {1, 6, 8}
    assert all(r.tokens <= 400 and r.tokens == estimate(r.text) for r in got)
    assert splitting.split_oversized(chunks.limit(0), limits).count() == 0
    assert splitting.split_oversized(chunks, limits.limit(0)).count() == 0
