import random
import re

import numpy as np
import pytest

from quire.llm import neardup


def texts(seed=4):
    rng = random.Random(seed)
    vocab = [f"w{n}" for n in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(3, 80))] for _ in range(60)]
    out = [" ".join(b) for b in base]
    for b in base[:30]:
        c = list(b)
        for _ in range(rng.randint(1, 12)):
            c[rng.randrange(len(c))] = rng.choice(vocab)
        out.append(" ".join(c))
    out += [out[0]] * 5 + [out[7]] + ["the same opening words " + " ".join(b[:6]) for b in base[:20]]
    return out + [None, "", "one two", "one two three"]


def brute(rows, t, w):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        sets[i] = {tuple(words[k : k + w]) for k in range(len(words) - w + 1)}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


@pytest.mark.parametrize("t,w,cheap,hot", [(0.5, 3, 200, 20_000), (0.5, 3, 0, 5), (0.8, 5, 1000, 4)])
def test_equals_brute_force(spark, t, w, cheap, hot):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, x, "c", 1) for i, x in rows] + [(0, rows[0][1], "c", 1)], "doc_id long, text string, id string, rep int")
    m, p = neardup.near_duplicates(df, threshold=t, w=w, cheap=cheap, hot=hot)
    got = [tuple(r) for r in neardup.expand_pairs(m, p).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, t, w)


def test_many_buckets_and_merged_sketches(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    m, p = neardup.near_duplicates(df, threshold=0.5, w=3, bucket_postings=20)
    assert {tuple(r) for r in neardup.expand_pairs(m, p).collect()} == brute(rows, 0.5, 3)
    parts = df.selectExpr("doc_id as id", "text").filter("text is not null").mapInArrow(neardup._survey(3), "id long, size int, a long, b long, sketch binary").filter("sketch is not null").select("sketch")
    one, many = neardup.merged_sketch(parts), neardup.merged_sketch(parts, at_once=2)
    assert (one.counters == many.counters).all()
    sets = neardup.shingle_sets([x for _, x in rows], 3)
    assert one.counters[0].sum() == sum(map(len, sets))


def test_sketch_tells_frequent_from_rare_far_below_any_share():
    rng = np.random.default_rng(2)
    sketch = neardup.Sketch()
    for _ in range(20):  # 20 million shingles that occur once
        sketch.add(rng.integers(0, 1 << 63, 1_000_000, dtype=np.uint64))
    common = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sketch.add(np.repeat(common, 300))  # a share of 1.5e-5 each
    rare = rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert (np.abs(sketch.estimate(common) - 300) < 60).mean() > 0.99
    assert (sketch.estimate(rare) > 200).mean() < 1e-3
    assert (neardup.Sketch.unpack(sketch.pack()).counters == sketch.counters).all()


def test_postings_of_a_record_stay_of_a_size_as_buckets_grow():
    import pyarrow as pa

    rng = random.Random(3)
    words = [f"w{n}" for n in range(20_000)]
    docs = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(1_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_000), pa.int64()), pa.array(docs)], ["id", "text"])
    sizes = {}
    for buckets in (8, 512, 4096):
        (out,) = neardup._postings(3, 0.5, neardup.Sketch(), buckets, 200, 20_000)(iter([batch]))
        sizes[buckets] = sum(len(x) for c in out.columns[1:] for x in c.to_pylist())
    assert sizes[4096] < 2 * sizes[8] and sizes[4096] < 1.2 * sizes[512]


def test_groups_are_components(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = brute(rows, 0.5, 3)
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.group for r in neardup.groups(*neardup.near_duplicates(df, threshold=0.5, w=3)).collect()}
    assert got == {i: root(i) for i in got} and {i for p in pairs for i in p} <= got.keys()


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) // 2], rng.integers(0, 1 << 62, rng.integers(1, 400), dtype=np.uint64)]))
        differ = neardup._differ([neardup.bitmap(a), neardup.bitmap(b)], np.array([0]), np.array([1]))[0]
        assert differ <= len(np.setxor1d(a, b))


def test_empty(spark):
    for rows in ([], [(1, None)], [(1, "x")]):
        m, p = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        assert neardup.expand_pairs(m, p).count() == 0 and neardup.groups(m, p).count() == 0


def test_short_and_null_texts_have_a_group(spark, tmp_path):
    from quire.llm.queries import p6_groups

    long = "one two three four five six seven eight nine ten"
    rows = [(1, long), (2, long), (3, "too short"), (4, "too short"), (5, None), (6, None), (7, ""), (3, "too short")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.group, r.links) for r in p6_groups(spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 3, 1), (5, 5, 0), (6, 6, 0), (7, 7, 0)}
