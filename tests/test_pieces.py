import random

from quire.functions.pieces import estimate, split_code, split_list, split_prose, split_table, split_words, take_last
from quire.operators.chunker import Block, chunk_blocks, chunk_starts, union_bbox


def test_estimate_counts_cjk_and_astral():
    assert estimate("") == 0
    assert estimate("abcd") == 1 and estimate("abcde") == 2
    assert estimate("漢字") == 2
    assert estimate("😀😀") == 1  # two UTF-16 units each
    assert estimate("漢abcd") == 2


def test_take_last_snaps_to_sentence_then_word():
    assert take_last("short", 10) == "short"
    text = "One two three. Four five six seven eight nine ten"
    assert take_last(text, 10) == "Four five six seven eight nine ten" or take_last(text, 10) in text
    assert not take_last("a" * 50 + " " + "b" * 30, 8).startswith("a")


def test_prose_keeps_sentences_and_budget():
    text = " ".join(f"Sentence number {n} is here." for n in range(60))
    parts = split_prose(text, 40)
    assert all(estimate(p) <= 40 for p in parts)
    assert " ".join(parts) == text
    assert split_prose("...  Kept as it is.", 40) == ["...  Kept as it is."]
    assert split_prose("...", 40) == ["..."] and split_prose("." * 400, 40) == ["." * 400]
    long = "..." + "Words of a sentence go on. " * 20
    assert split_prose(long, 40)[0].startswith("Words")  # of a longer text a leading run of dots is lost


def test_words_giant_word_stays_whole():
    parts = split_words("a " + "x" * 400 + " b", 20)
    assert "x" * 400 in parts


def test_list_code_table_repeat_their_frames():
    items = split_list("\n".join(f"- item {n} with some words\n  more" for n in range(30)), 40)
    assert all(p.startswith("- ") for p in items) and sum(p.count("- item") for p in items) == 30
    code = split_code("```py\n" + "\n".join(f"line_{n} = {n}" for n in range(100)) + "\n```", 50)
    assert all(p.startswith("```py\n") and p.endswith("\n```") for p in code)
    assert sum(p.count("line_") for p in code) == 100
    table = split_table("| a | b |\n| --- | --- |\n" + "\n".join(f"| {n} | row |" for n in range(300)), 60)
    assert all(p.startswith("| a | b |\n| --- | --- |\n") for p in table)
    assert sum(p.count("row") for p in table) == 300
    assert split_table("no pipes here. At all.", 100) == ["no pipes here. At all."]
    bare = split_code("\n".join(f"line_{n} = {n}" for n in range(100)), 50)
    assert all(p.startswith("```\n") and p.endswith("\n```") and estimate(p) <= 50 for p in bare)
    assert split_words("a" * 8 + " " + "b" * 8, 4) == ["a" * 8, "b" * 8]  # the blank counts with what follows it


def test_chunks_never_mix_locators_and_keep_all_text():
    rng = random.Random(5)
    for _ in range(40):
        blocks = []
        for page in range(rng.randint(1, 5)):
            for n in range(rng.randint(1, 8)):
                kind = rng.choice(["heading", "paragraph", "paragraph", "list", "table", "code"])
                body = f"P{page}B{n} " + "word " * rng.randint(1, 120)
                text = {"table": f"| {body} |\n| --- |\n| x |", "code": f"```\n{body}\n```", "list": f"- {body}"}.get(kind, body).strip()
                blocks.append(Block(kind, text, str(page), page, ["S"]))
        chunks = list(chunk_blocks(blocks))
        for c in chunks:
            assert all(f"P{p}B" not in c.text for p in range(6) if str(p) != c.locator)
        joined = " ".join(c.text for c in chunks)
        for b in blocks:
            assert b.text.split()[1 if b.kind in ("table", "list", "code") else 0] in joined
        assert [c.ordinal for c in chunks] == sorted(c.ordinal for c in chunks)


def test_table_stands_alone_with_its_heading_and_overlap_needs_same_section():
    blocks = [Block("paragraph", "Some prose here. " * 5, path=["A"]), Block("heading", "# T", path=[]), Block("table", "| a |\n| --- |\n| 1 |", path=["T"]), Block("paragraph", "After.", path=["T"])]
    chunks = list(chunk_blocks(blocks))
    assert [c.kind for c in chunks] == ["text", "table", "text"]
    assert chunks[1].text.startswith("# T\n\n| a |")
    assert chunks[1].overlap == "" and chunks[2].overlap != ""


def test_headings_only_and_empty():
    (one,) = chunk_blocks([Block("heading", "# Alone", path=["Up"])])
    assert one.kind == "heading" and one.path == ["Up", "Alone"]
    assert list(chunk_blocks([])) == []


def test_union_bbox():
    assert union_bbox([None, [0.1, 0.2, 0.3, 0.1], [0.5, 0.1, 0.1, 0.4]]) == [0.1, 0.1, 0.5, 0.4]
    assert union_bbox([None]) is None


def test_chunk_starts_follow_from_sizes_and_kinds():
    text, head, table = "text", "heading", "table"
    assert chunk_starts([], [], 10, 12) == []
    assert chunk_starts([text] * 4, [4, 4, 4, 4], 10, 12) == [0, 3]  # target reached with the third
    assert chunk_starts([text] * 3, [5, 8, 1], 10, 12) == [0, 1]  # 13 would be too much
    assert chunk_starts([text, head, text], [1, 1, 1], 10, 12) == [0, 1]  # a heading after body opens a chunk
    assert chunk_starts([head, head, text, text], [1, 1, 1, 1], 10, 12) == [0]
    assert chunk_starts([head, head, text], [6, 6, 6], 10, 12) == [0]  # headings are carried, whatever they weigh
    assert chunk_starts([text, table, text, head, table, head], [1, 1, 1, 1, 1, 1], 10, 12) == [0, 1, 2, 3, 5]
    assert chunk_starts([text, head, text, text], [1, 1, 20, 1], 10, 12) == [0, 1, 3]  # one beyond the most stands alone


def test_headings_over_a_split_block_count_in_its_box():
    big = "Sentence of some words here. " * 80
    chunks = list(chunk_blocks([Block("heading", "# H", "1", 0, [], [0, 0, 2, 1]), Block("paragraph", big, "1", 0, ["H"], [0, 1, 4, 2])]))
    assert len(chunks) > 1 and chunks[0].text.startswith("# H\n\nSentence") and chunks[0].bbox == [0, 0, 4, 3]
    assert chunks[1].bbox == [0, 1, 4, 2] and chunks[1].overlap
