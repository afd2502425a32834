from quire.llm import mixing


def test_budgets_epochs_and_short_sources(spark):
    docs = [(n, "big", "w " * (10 + n % 7)) for n in range(300)] + [(1000 + n, "small", "w " * 20) for n in range(5)] + [(2000, None, "w"), (2001, "other", "w " * 900), (2002, "big", None), (2003, "big", "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, source string, text string, tokens int, key int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.1, 2), ("small", 0.1, 2), ("none", 0.4, 3)], "source string, target_share double, max_repeats int")
    mixture, report = mixing.mix_sources(df, targets)
    rep = {r.source: r for r in report.collect()}
    total = sum(10 + n % 7 for n in range(300)) + 100
    assert rep["big"].size == total - 100 and not rep["big"].short
    assert rep["small"].short and rep["none"].short and rep["none"].taken_tokens == 0
    assert rep["small"].taken_tokens == 200  # both epochs whole
    assert 0 <= 0.5 * total - rep["big"].taken_tokens < 17
    rows = mixture.collect()
    assert {r.repeats for r in rows if r.source == "small"} == {2}
    assert max(r.repeats for r in rows if r.source == "big") == 1
    assert {r.source for r in rows} == {"big", "small"}
    assert abs(sum(r.reached_share for r in rep.values()) - 1) < 1e-9
    again = {tuple(r) for r in mixing.mix_sources(df, targets)[0].collect()}
    assert again == {tuple(r) for r in rows}


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    m, r = mixing.mix_sources(spark.createDataFrame([], "doc_id long, source string, text string"), targets)
    assert m.count() == 0 and [x.taken_tokens for x in r.collect()] == [0]
    m, r = mixing.mix_sources(spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string"), targets.limit(0))
    assert m.count() == 0 and r.count() == 0
