import pytest
from pyspark.sql import functions as F

from quire.operators import chunker, evaluation, hybrid, vectors


def test_section_prefix(spark):
    cases = [(["Part II", "3.2 Loads"], "part ii › 3.2", True), (["Part III"], "Part II", False), (["3.25"], "3.2", False), (["A", "B"], "a > b", True), (["A"], "A › B", False), (["A"], "", True), ([], "A", False), (None, " › ", True)]
    df = spark.createDataFrame([(n, p, q) for n, (p, q, _) in enumerate(cases)], "n int, path array<string>, prefix string")
    got = {r.n: r.ok for r in df.select("n", F.coalesce(hybrid.section_matches(F.col("path"), F.col("prefix")), F.lit(False)).alias("ok")).collect()}
    assert [got[n] for n in range(len(cases) - 1)] == [x for _, _, x in cases[:-1]]


def ranked(spark, lexical, semantic):
    rows = [(1, i, "lexical", n + 1) for n, i in enumerate(lexical)] + [(1, i, "semantic", n + 1) for n, i in enumerate(semantic)]
    return spark.createDataFrame(rows, "question_id long, id long, leg string, rank int")


def test_fusion_orders_and_breaks_ties(spark):
    got = [r.id for r in hybrid.fused_top(ranked(spark, [1, 2, 3], [9, 2, 8]), 4).orderBy("rank").collect()]
    assert got[0] == 2  # agreement: 1/4 + 1.5/4 beats 1.5/3
    tie = [r.id for r in hybrid.fused_top(ranked(spark, [5], [4]), 2, hybrid.Tuning(2, 1, 1)).orderBy("rank").collect()]
    assert tie == [4, 5]
    only = [r.id for r in hybrid.fused_top(ranked(spark, [5], [4]), 2, hybrid.Tuning(2, 0, 1)).collect()]
    assert only == [4]


@pytest.fixture(scope="module")
def seeded(spark):
    rows = []
    for n in range(300):
        kind = "table" if n == 290 else "text"
        rows.append((n, "d0" if n < 299 else "d1", n, kind, 1 + n % 100, ["Special"] if n == 280 else ["Main"], f"common rank{n:03d}"))
    chunks = spark.createDataFrame(rows, "id long, document_id string, seq int, kind string, page_number int, section_path array<string>, text string")
    docs = spark.createDataFrame([("d0", "ready"), ("d1", "processing")], "document_id string, ingest_status string")
    vec = chunks.select("id", F.concat(F.array(F.col("id").cast("float")), F.array_repeat(F.lit(0.0).cast("float"), 383)).alias("embedding"))
    q = spark.createDataFrame([(7, "common rank290")], "question_id long, question string").withColumn("embedding", F.array_repeat(F.lit(0.0).cast("float"), 384))
    return chunks, docs, vec, q


def run(seeded, **how):
    return [(r.id, r.round) for r in hybrid.hybrid_search(*seeded, stem=False, **how).orderBy("rank").collect()]


def test_semantic_order_and_readiness(seeded):
    assert [i for i, _ in run(seeded, mode="semantic", k=5)] == [0, 1, 2, 3, 4]
    assert 299 not in [i for i, _ in run(seeded, mode="lexical", k=50)]


def test_rare_kind_survives_by_overfetch_and_keeps_its_rank(seeded):
    got = hybrid.hybrid_search(*seeded, mode="semantic", k=10, filters=hybrid.Filters(kind="table")).collect()
    assert [r.id for r in got] == [290]
    assert abs(got[0].score - 1 / (2 + 291)) < 1e-9  # ranked among all, not among tables


def test_escalation_reaches_a_far_section(seeded):
    got = run(seeded, mode="semantic", k=2, filters=hybrid.Filters(section="Special"))
    assert got == [(280, 3)]  # 64, 128, 256, 512


def test_pages_and_document_filters(seeded):
    pages = run(seeded, mode="semantic", k=3, filters=hybrid.Filters(pages=(5, 6)))
    assert [i for i, _ in pages] == [4, 5, 104]
    assert run(seeded, mode="semantic", k=3, filters=hybrid.Filters(document_id="d1")) == []
    with pytest.raises(ValueError):
        hybrid.Filters(pages=(3, 2))
    with pytest.raises(ValueError):
        run(seeded, k=0)


def test_empty_corpus(spark, seeded):
    chunks, docs, vec, q = seeded
    assert hybrid.hybrid_search(chunks.limit(0), docs, vec.limit(0), q).count() == 0


def test_knn_ties_take_the_smaller_id(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "question_id long, embedding array<float>")
    assert [r.id for r in vectors.knn(q, v, 2).orderBy("rank").collect()] == [1, 3]


def test_knn_by_scan_and_by_slices_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[5] = x[6]
    v = spark.createDataFrame([(n, [float(a) for a in r], f"d{n % 3}") for n, r in enumerate(x)], "id long, embedding array<float>, document_id string")
    q = v.filter("id % 10 = 5").withColumnRenamed("id", "question_id")
    for within in (None, "document_id"):
        want = set()
        for a in range(5, 700, 10):
            d = np.sqrt(((x.astype(float) - x[a]) ** 2).sum(1))
            pool = [n for n in range(700) if not within or n % 3 == a % 3]
            want |= {(a, n, k + 1) for k, n in enumerate(sorted(pool, key=lambda n: (round(d[n], 9), n))[:4])}
        for how in ({}, {"block": 8}, {"block": 8, "most_blocks": 1, "slice_rows": 100}):
            assert {(r.question_id, r.id, r["rank"]) for r in vectors.knn(q, v, 4, within, **how).collect()} == want
    assert vectors.knn(q.limit(0), v, 4).count() == 0 and vectors.knn(q, v.limit(0), 4).count() == 0


def test_an_embedder_must_give_a_vector_for_each_text(spark):
    class Short(vectors.StubEmbedder):
        def embed(self, texts):
            return super().embed(texts)[:-1]

    t = spark.createDataFrame([(n, "some words") for n in range(3)], "id long, text string")
    with pytest.raises(Exception, match="gave"):
        vectors.embed(t, "id", "text", Short()).collect()


def test_an_index_is_written_once_and_read_by_term(spark, tmp_path):
    from quire.operators import fulltext

    rows = [(n, f"common word{n} and more text {n % 7}") for n in range(200)]
    path = str(tmp_path / "chunks.parquet")
    spark.createDataFrame(rows, "id long, text string").write.parquet(path)
    one, two = (fulltext.index_of(spark.read.parquet(path)) for _ in range(2))
    assert one.rows.inputFiles() == two.rows.inputFiles()
    q = spark.createDataFrame([(1, "word17 absent")], "question_id long, question string")
    found = fulltext.bm25(one, q)
    assert [r.id for r in found.collect()] == [17]
    scan = one.of_terms(spark.createDataFrame([("word17",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [word17])]" in scan or "EqualTo(term,word17)" in scan
    spark.createDataFrame([(500, "fresh text")], "id long, text string").write.mode("append").parquet(path)
    assert fulltext.index_of(spark.read.parquet(path)).rows.inputFiles() != one.rows.inputFiles()


def test_stub_embedding_is_unit_and_matches_fnv(spark):
    def fnv(t):
        h = 2166136261
        for c in t:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h

    t = spark.createDataFrame([(1, "Über den Fluss den"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r.embedding for r in vectors.stub_embed(t, "id", "text").collect()}
    want = [0.0] * 384
    for w, n in (("über", 1), ("den", 2), ("fluss", 1)):
        want[fnv(w) % 384] += n
    size = sum(x * x for x in want) ** 0.5
    assert all(abs(a - b / size) < 1e-6 for a, b in zip(got[1], want))
    assert not any(got[2]) and not any(got[3])


def test_context_trims_front_then_back(spark):
    c = spark.createDataFrame([(n, "d", n, "x" * 10) for n in range(10)], "id long, document_id string, seq int, text string")
    a = c.filter("id = 5")
    got = chunker.context(c, a, 2, 2, 35).orderBy("seq").collect()
    assert [r.seq for r in got] == [5, 6, 7] and got[0].has_more_before and got[0].has_more_after
    got = chunker.context(c, a, 2, 2, 15).orderBy("seq").collect()
    assert [r.seq for r in got] == [5] and got[0].has_more_after
    got = chunker.context(c, c.filter("id = 0"), 1, 1).orderBy("seq").collect()
    assert [r.seq for r in got] == [0, 1] and not got[0].has_more_before and got[0].has_more_after
    got = chunker.context(c, c.filter("id = 9"), 1, 1).orderBy("seq").collect()
    assert not got[0].has_more_after


def test_outline_reenters_sections(spark):
    trail = [["A"], ["A", "B"], ["A", "B"], ["A"], ["C"], ["A", "B"], [], None]
    c = spark.createDataFrame([("d", n, f"p{n}", p) for n, p in enumerate(trail)], "document_id string, seq int, locator_value string, section_path array<string>")
    got = [(r.level, r.title, r.seq_start, r.seq_end) for r in chunker.outline(c).orderBy("seq_start", "level").collect()]
    assert got == [(1, "A", 0, 3), (2, "B", 1, 2), (1, "C", 4, 4), (1, "A", 5, 5), (2, "B", 5, 5)]


def test_metrics(spark):
    best = spark.createDataFrame([("a", 1), ("b", 4), ("c", None), ("d", 2)], "q string, best int")
    m = evaluation.metrics(best).first()
    assert (m.recall_1, m.recall_3, m.recall_5) == (0.25, 0.5, 0.75) and abs(m.mrr - (1 + 0.25 + 0.5) / 4) < 1e-9


def test_semantic_snippet():
    text = "Filler words here. " * 30 + "The badger ate the turnip. " + "Other filler. " * 30
    s = hybrid.semantic_snippet(text, "badger turnip")
    assert "badger ate" in s and s.startswith("…") and s.endswith("…") and len(s) <= 302
    assert hybrid.semantic_snippet("short", "x") == "short"
    near_end = "Filler words here. " * 30 + "The badger ate the turnip."
    s = hybrid.semantic_snippet(near_end, "badger turnip")
    assert s.startswith("…") and s.endswith("turnip.") and len(s) == 1 + 164  # half of the sentence and 150 before its middle: the window ends with the text, it is not pushed back
    assert hybrid.semantic_snippet("No match at all. " * 40, "zebra").endswith("…")
    wide = "😀" * 140 + ". The badger ate. " + "Other filler words. " * 20
    assert "badger" in hybrid.semantic_snippet(wide, "badger")


def test_question_sets_and_reports(spark, tmp_path):
    import json

    def write(questions):
        p = tmp_path / f"q{len(list(tmp_path.iterdir()))}.json"
        p.write_text(json.dumps({"corpus": "c", "questions": questions}))
        return str(p)

    one = {"id": "a", "question": "Where?", "type": "prose", "accept": [{"source_path": "p", "anchor": "x"}]}
    assert evaluation.load_questions(spark, write([one])).first().accept[0].anchor == "x"
    for bad in ([one, one], [{**one, "type": "other"}], [{**one, "accept": []}]):
        with pytest.raises(ValueError):
            evaluation.load_questions(spark, write(bad))
    m = evaluation.metrics(spark.createDataFrame([("hybrid", 1)], "mode string, best int"), ("mode",))
    assert evaluation.report(m)[1].split() == ["hybrid", "1", "1.000", "1.000", "1.000", "1.000"]
    assert json.loads(evaluation.report(m, True)[0])["mrr"] == 1.0


def test_lookups(spark):
    from quire.operators import lookups

    c = spark.createDataFrame([(n, f"c{n}", "d", n) for n in range(20)], "id long, chunk_id string, document_id string, seq int")
    assert lookups.chunk_exists(c, "d", 3) and not lookups.chunk_exists(c, "d", 30)
    assert lookups.by_chunk_id(c, "c4").first().seq == 4
    a, b = [r.id for r in lookups.random_sample(c, 8).collect()], [r.id for r in lookups.random_sample(c, 8).collect()]
    assert a == b and len(set(a)) == 8 and a != [r.id for r in lookups.random_sample(c, 8, seed=1).collect()]


def test_ground_truth_of_many_anchors_in_one_document(spark):
    import random

    rng = random.Random(9)
    texts = [" ".join(rng.choice(["rope", "Mill", "über", "x"]) + rng.choice([" ", "\n\t", " "]) for _ in range(40)) for _ in range(30)]
    chunks = spark.createDataFrame([(n, "hot" if n < 25 else f"d{n}", t) for n, t in enumerate(texts)] + [(90, "hot", None), (91, None, texts[0])], "id long, document_id string, text string")
    docs = spark.createDataFrame([("hot", "p", "ready"), ("d27", "p", "ready"), ("d28", "p", "failed"), ("d29", "r", "ready")], "document_id string, source_path string, ingest_status string")
    flat = lambda t: " ".join(t.lower().split())
    asked = []
    for n in range(120):
        t = texts[n % 30]
        at = rng.randrange(len(t) - 30)
        asked.append((n, "r" if n % 7 == 0 else "p", t[at : at + rng.choice([2, 5, 9, 24])]))
    q = spark.createDataFrame([*asked, (900, "p", None), (901, None, "x"), (902, "p", " \n")], "question_id long, source_path string, anchor string")
    at = {"p": [*range(25), 27], "r": [29]}
    want = {(n, i) for n, path, a in asked for i in at[path] if flat(a) and flat(a) in flat(texts[i])}
    for how in ({}, {"block": 17}):
        got = [tuple(r) for r in evaluation.ground_truth(q, docs, chunks, **how).collect()]
        assert set(got) == want and len(got) == len(want)


def test_ground_truth_normalises_a_text_once_and_shuffles_none(spark):
    chunks = spark.range(50).selectExpr("id", "'d' AS document_id", "concat('Word ', id) AS text")
    docs = spark.createDataFrame([("d", "p", "ready")], "document_id string, source_path string, ingest_status string")
    q = spark.createDataFrame([(n, "p", f"word {n}") for n in range(40)], "question_id long, source_path string, anchor string")
    plan = evaluation.ground_truth(q, docs, chunks)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "SortMergeJoin" not in below and "regexp_replace" in below and "Contains" not in plan


def test_evaluation_queries_stage_the_truth_and_their_ranks(spark):
    from quire import registry

    d = "/root/testdata/sf0.001"
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name in ("unresolvable", "recall_mrr", "recall_by_type", "hybrid_verdict"):
        plan = scans(registry.queries()[name](spark, d))
        assert "document_chunks.parquet" not in plan and "hits.parquet" not in plan, name


def test_knn_by_a_sampled_reach_equals_all_distances(spark):
    import random

    rng = random.Random(11)
    ids = spark.range(800).select("id", (F.pmod(F.xxhash64("id"), F.lit(4)) == 0).alias("sampled")).collect()
    close = [r.id for r in ids if r.sampled][:30]  # the reach guessed for query 1 holds 30 vectors, 40 are asked for
    rows = [(r.id, [100.0, rng.choice([0.0, 0.25])] if r.id in close else [rng.choice([0.0, 1.0, 2.0, 3.0]), float(rng.randint(0, 9))]) for r in ids]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    asked = [(1, [100.0, 0.0]), (2, [1.0, 1.0]), (3, [2.5, 4.0]), (4, [0.0, 0.0])]
    q = spark.createDataFrame(asked, "question_id long, embedding array<float>")
    for k in (3, 40):
        want = set()
        for n, a in asked:
            near = sorted((round(((a[0] - x[0]) ** 2 + (a[1] - x[1]) ** 2) ** 0.5, 9), i) for i, x in rows)[:k]
            want |= {(n, i, at + 1) for at, (_, i) in enumerate(near)}
        got = vectors.knn(q, v, k, block=3, sample=4).collect()
        assert {(r.question_id, r.id, r["rank"]) for r in got} == want and len(got) == len(want)


def test_a_round_searches_only_the_queries_that_need_it(spark, seeded, monkeypatch):
    chunks, docs, vec, q = seeded
    far = F.concat(F.array(F.lit(299.0).cast("float")), F.array_repeat(F.lit(0.0).cast("float"), 383))
    both = q.unionByName(spark.createDataFrame([(8, "absent")], "question_id long, question string").withColumn("embedding", far))
    calls, knn = [], vectors.knn
    monkeypatch.setattr(vectors, "knn", lambda asked, pool, k, **how: (calls.append((k, sorted(r.question_id for r in asked.collect()))), knn(asked, pool, k, **how))[1])
    got = hybrid.hybrid_search(chunks, docs, vec, both, 1, "semantic", hybrid.Filters(kind="table")).collect()
    assert {(r.question_id, r.id, r["round"]) for r in got} == {(8, 290, 0)}  # 7 is 290 away, beyond 256
    assert calls == [(32, [7, 8]), (64, [7]), (128, [7]), (256, [7])]


def test_plain_hybrid_search_asks_for_one_bounded_round(spark, seeded, monkeypatch):
    calls, knn = [], vectors.knn
    monkeypatch.setattr(vectors, "knn", lambda asked, pool, k, **how: (calls.append((k, how)), knn(asked, pool, k, **how))[1])
    assert len(run(seeded, k=3)) == 3
    assert calls == [(6, {"sample": 16})]
