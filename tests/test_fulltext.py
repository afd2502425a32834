import sqlite3

import pytest

from quire.functions.stem import porter
from quire.operators import fulltext

TEXTS = {1: "The badgers were running near cafés and the old mill.", 2: "A badger runs; don't feed the self-attention badger.", 3: "Nothing of note happened in the mill today.", 4: None, 5: "", 6: "Running running RUNNING mill mill", 7: "café au lait in the old town"}


def sqlite_index(tokenize):
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE f USING fts5(x, tokenize='{tokenize}')")
    con.executemany("INSERT INTO f(rowid, x) VALUES (?, ?)", [(k, v or "") for k, v in TEXTS.items()])
    return con


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(list(TEXTS.items()), "id long, text string")


@pytest.mark.parametrize("stem", [False, True])
def test_bm25_equals_sqlite(spark, chunks, stem):
    con = sqlite_index(("porter " if stem else "") + "unicode61 remove_diacritics 2")
    for question, match in [("badger mill", '"badger" OR "mill"'), ("self-attention", '"self-attention"'), ("don't run cafe", '"don\'t" OR "run" OR "cafe"'), ("mill mill", '"mill" OR "mill"')]:
        want = dict(con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,)).fetchall())
        q = spark.createDataFrame([(1, question)], "question_id long, question string")
        got = {r.id: r.score for r in fulltext.bm25(fulltext.index_of(chunks, stem), q).collect()}
        assert got.keys() == want.keys(), question
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want), (question, got, want)


def test_porter_equals_sqlite():
    words = "caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll was is by generalizations oscillators".split()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(x, tokenize='porter ascii')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    con.execute("INSERT INTO f VALUES (?)", (" ".join(words),))
    want = [t for t, in con.execute("SELECT term FROM v ORDER BY offset").fetchall()]
    got = [porter(w) for w in words]
    assert {w: (g, x) for w, g, x in zip(words, got, want) if g != x} == {}


def test_phrases_positions_and_empty_queries(spark, chunks):
    q = spark.createDataFrame([(1, "???"), (2, None)], "question_id long, question string")
    assert fulltext.bm25(fulltext.index_of(chunks), q).count() == 0
    assert spark.range(1).select(fulltext.match_expression(F_lit("a b-c ?"))).first()[0] == '"a" OR "b-c"'


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


@pytest.mark.parametrize("stem", [False, True])
def test_snippet_equals_sqlite(stem):
    import random

    rng = random.Random(3)
    words = "alpha beta gamma delta badger badgers mill mills rope don't self-attention über old new on at in the".split()
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE f USING fts5(x, tokenize='{'porter ' if stem else ''}unicode61 remove_diacritics 2')")
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", "", ".", ",", ":", "; "]) for _ in range(rng.randint(1, 70))) for _ in range(300)]
    con.executemany("INSERT INTO f(rowid, x) VALUES (?, ?)", list(enumerate(texts)))
    queries = [["badger"], ["mill", "rope"], ["self-attention", "old"], ["don't", "alpha", "über"], ["badgers", "beta", "mill", "new"], ["rope", "rope"]]
    cut = lambda t: [porter(x) if stem else x for x in __import__("re").findall(r"[^\W_]+", t.lower().replace("ü", "u"))]
    for q in queries:
        match = " OR ".join('"' + t + '"' for t in q)
        want = dict(con.execute("SELECT rowid, snippet(f, 0, '«', '»', '…', 12) FROM f WHERE f MATCH ?", (match,)).fetchall())
        got = {k: fulltext.snippet(texts[k], [cut(t) for t in q], stem=stem) for k in want}
        wrong = [(texts[k], want[k], got[k]) for k in want if got[k] != want[k]]
        assert not wrong, (q, len(wrong), len(want), wrong[0])


def test_snippet_marks_and_clips():
    words = " ".join(f"pad{n}" for n in range(60)).split()
    words[30] = "badgers"
    s = fulltext.snippet(" ".join(words), [["badgers"]])
    assert "«badgers»" in s and s.startswith("…") and s.endswith("…") and len(s.split()) == 12
    assert fulltext.snippet("only badgers", [["badgers"]]) == "only «badgers»"
    assert fulltext.snippet("", [["x"]]) == "" and fulltext.snippet("no match", []) == "no match"


def test_stems_in_sql_equal_the_stemmer():
    import duckdb

    from quire.functions.stem import stems_sql

    words = "caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer conformabli vietnamization predication operator feudalism decisiveness hopefulness formaliti sensibiliti triplicate formative formalize electrical hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption communism activate angulariti homologous effective bowdlerize probate rate cease controll roll was is by über größe ééing the yes toying dying skies lyon boyed ions station be".split()
    con = duckdb.connect()
    con.execute("CREATE TABLE words AS SELECT unnest(?) AS w", [words])
    got = dict(con.execute(f"WITH {stems_sql('words')} SELECT w, s FROM stems").fetchall())
    assert {w: (got[w], porter(w)) for w in words if got[w] != porter(w)} == {}


def test_bm25_best_of_slices_and_blocks_equal_all_scores(spark):
    import random

    rng = random.Random(5)
    words = ["the"] * 30 + ["a", "of"] * 8 + [f"w{n}" for n in range(12)]
    texts = [(n, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for n in range(160)]
    texts += [(n + 1000, t) for n, t in texts[:60]]  # copies tie
    index = fulltext.index_of(spark.createDataFrame(texts, "id long, text string"))
    asked = ["the w1", "w1 the", "the a of w2 w3", "w4-w5 the", "the", "w6 w6 w7", "absent", None, *(f"of w{n} a" for n in range(8))]
    q = spark.createDataFrame(list(enumerate(asked)), "question_id long, question string")
    only = spark.createDataFrame([(n,) for n, _ in texts if n % 3], "id long")
    for limit in (None, only):
        every: dict[int, list] = {}
        for r in fulltext.bm25(index, q, limit).collect():
            assert limit is None or r.id % 3
            every.setdefault(r.question_id, []).append((round(r.score, 9), r.id))
        want = {(n, i, x, at + 1) for n, rows in every.items() for at, (x, i) in enumerate(sorted(rows)[:5])}
        for how in ({}, {"block": 3, "most_blocks": 2, "slice_rows": 7}):
            got = fulltext.bm25(index, q, limit, 5, **how).collect()
            assert {(r.question_id, r.id, round(r.score, 9), r["rank"]) for r in got} == want


def test_bm25_shuffles_only_the_best_of_a_slice(spark, chunks):
    q = spark.createDataFrame([(n, "mill near") for n in range(50)], "question_id long, question string")
    best = fulltext.bm25(fulltext.index_of(chunks), q, k=1)
    assert best.count() == 50
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("WindowGroupLimit") < plan.index("FlatMapGroupsInArrow")
