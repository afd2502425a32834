import random

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans.prefix import prefix_sums
from quire.plans.storage import shared_folder, staged


def test_prefix_sums_over_a_hot_group_and_nulls(spark):
    rng = random.Random(3)
    rows = [("hot", n, rng.randint(0, 9)) for n in range(3000)] + [(None, n, 1) for n in range(5)] + [("one", 0, 7)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {(r.g, r.k): r.upto for r in prefix_sums(df, ["g"], ["k"], "v", "upto").collect()}
    want, sums = {}, {}
    for g, k, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        sums[g] = sums.get(g, 0) + v
        want[g, k] = sums[g]
    assert got == want
    assert prefix_sums(df.limit(0), ["g"], ["k"], "v", "upto").count() == 0


def test_staging_is_in_the_named_folder(spark):
    df = staged(spark.range(5), "t")
    assert df.count() == 5 and all(shared_folder(spark) in f for f in df.inputFiles())
    assert shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


TINY = {
    "document_chunks": "SELECT * FROM (VALUES (1::BIGINT, 'c1', 'd1', 0, 'text', 'section', 'sec-1', 0, NULL::INT, NULL::VARCHAR, ['A'], NULL::DOUBLE[], 'The rope was tested.', 5), (2, 'c2', 'd1', 1, 'table', 'section', 'sec-1', 0, NULL, NULL, ['A'], NULL, NULL, NULL), (3, 'c3', 'd2', 0, 'text', 'page', '1', 0, 1, 'i', NULL, NULL, '', 0)) t(id, chunk_id, document_id, seq, kind, locator_type, locator_value, locator_ordinal, page_number, printed_label, section_path, bbox, text, token_count)",
}


@pytest.mark.parametrize("name", ["token_estimate", "chunk_stats", "chunk_overlap", "postings", "doc_lengths", "corpus_stats", "outline_nodes", "seq_range", "locator_counts"])
def test_nulls_and_empty_texts_agree_with_sql(spark, tmp_path, name):
    con = duckdb.connect()
    for t, sql in TINY.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    plain = lambda x: round(float(x), 6) if isinstance(x, float) else x
    want = sorted(repr([plain(r[cols.index(c)]) for c in sorted(cols)]) for r in cur.fetchall())
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert got == want


def test_previous_rows_over_slices(spark):
    from quire.plans.prefix import with_previous

    rows = [("hot", n, f"v{n}") for n in range(200)] + [("b", 0, "x"), ("b", 5, None), ("b", 9, "y"), (None, 1, "p"), (None, 2, "q")]
    df = spark.createDataFrame(rows, "g string, seq int, v string").repartition(3)
    got = {(r.g, r.seq): (r.previous.v, r.previous.seq) if r.previous else None for r in with_previous(df, ["g"], "seq", ["v", "seq"]).collect()}
    want, last = {}, {}
    for g, n, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want[(g, n)] = last.get(g)
        last[g] = (v, n)
    assert got == want
    assert with_previous(df.limit(0), ["g"], "seq", ["v"]).count() == 0
