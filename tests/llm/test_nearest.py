import numpy as np
import pytest

from quire.llm import nearest

SCHEMA = "chunk_rowid long, embedding array<float>, id string, heap int, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)  # clashing names on purpose


def brute(rows, k):
    usable = [(i, v) for i, v in rows if i is not None and v is not None and len(v) == 4 and np.isfinite(v).all() and np.any(v)]
    rows = {i: min(v for j, v in usable if j == i) for i in {i for i, _ in usable}}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], dtype=np.float32).astype(float)
    pairs = set()
    for a in range(len(ids)):
        d = ((x - x[a]) ** 2).sum(1)
        d[a] = np.inf
        for b in np.lexsort((ids, d))[: min(k, len(ids) - 1)]:
            pairs.add((min(ids[a], ids[b]), max(ids[a], ids[b])))
    return pairs


def found(spark, data, k=3, **how):
    out = nearest.neighbour_pairs(nearest.nearest_vectors(frame(spark, data), k=k, dim=4, **how))
    assert out.columns == ["chunk_rowid_a", "chunk_rowid_b"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_dirty_rows_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(n, [float(v) for v in rng.normal(size=4)]) for n in range(40)]
    rows += [(100 + n, [1.0, 0.0, 0.0, 0.0]) for n in range(9)]  # more copies than k
    rows += [(3, rows[3][1]), (200, None), (201, [0.0] * 4), (202, [1.0, 2.0]), (203, [float("nan"), 0.0, 0.0, 1.0]), (204, [float("inf"), 0.0, 0.0, 1.0]), (None, [1.0, 1.0, 0.0, 0.0])]
    assert found(spark, rows) == brute(rows, 3)


def test_exact_when_reach_is_infinite_and_recall_below(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 4))
    rows = [(n, [float(v) for v in centres[n % 30] + 0.2 * rng.normal(size=4)]) for n in range(900)]
    want = brute(rows, 3)
    assert found(spark, rows, rows=60, block_rows=200, reach=np.inf) == want
    part = found(spark, rows, rows=60, block_rows=200)
    assert len(part & want) / len(want) >= 0.9


def test_regions_and_cells_that_are_not_broadcast(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 4))
    rows = [(n, [float(v) for v in centres[n % 40] + 0.1 * rng.normal(size=4)]) for n in range(1600)]
    want = brute(rows, 3)
    small = dict(rows=20, block_rows=100, region_rows=300, fit_rows=200)
    assert found(spark, rows, reach=np.inf, **small) == want
    assert found(spark, rows, reach=np.inf, broadcast_cells=0, **small) == want
    for how in (small, {**small, "broadcast_cells": 0}):
        assert len(found(spark, rows, **how) & want) / len(want) >= 0.9


def test_an_id_with_two_vectors_takes_part_with_the_least(spark):
    rng = np.random.default_rng(6)
    left, right = [-5.0, 0.0, 0.0, 0.0], [5.0, 0.0, 0.0, 0.0]
    rows = [(10 + n, [a + 0.01 * float(v) for a, v in zip(left if n % 2 else right, rng.normal(size=4))]) for n in range(40)]
    rows += [(1, right), (1, left), (2, right)]
    got = found(spark, rows)
    assert got == brute(rows, 3)
    assert all(b == 1 or b % 2 for a, b in got if a == 1)  # id 1 is of the left ones only


def test_many_cells_in_bounded_memory():
    import resource

    rng = np.random.default_rng(7)
    x = rng.normal(size=(24_000, 16)).astype(np.float32)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    c = nearest.fit_cells(x, 3_000, rounds=2)
    own = nearest._closest(x, c)
    assert len(own) == len(x) and len(c) > 2_900
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # the whole matrix would take 288 MB
    # 30,000 cells as a tree of 64 regions: a batch meets the centres of few nodes at a time
    top = rng.normal(size=(64, 16)).astype(np.float32) * 4
    kids = (top[:, None] + rng.normal(size=(64, 470, 16))).reshape(-1, 16).astype(np.float32)
    parent = np.concatenate([np.full(64, -1), np.repeat(np.arange(64), 470)])
    block = np.concatenate([np.full(64, -1), np.arange(len(kids))])
    one = np.ones(len(parent), dtype=np.int32)
    tree = nearest.Tree(parent, np.concatenate([top, kids]), block, one, one)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    row, leaf = tree.leaves(kids[::7], 0.0)
    assert np.array_equal(tree.block[leaf[np.unique(row, return_index=True)[1]]], np.arange(0, len(kids), 7))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_hot_blocks_are_cut(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4)).astype(np.float32)
    tree = nearest.grow(x, 100.0, 10_000, 10_000, 0.1, heavy=2_000)
    assert tree.splits.tolist() == [3] and tree.slices.tolist() == [3]
    p = tree.places(np.arange(60), x, 0.1)
    for i in range(60):  # every slice meets every split once: three cells to own, three to ask, one of them both
        mine = p["row"] == i
        assert mine.sum() == 5 and p["own"][mine].sum() == 3 and p["asks"][mine].sum() == 3
        assert len(set(p["split"][mine & p["own"]])) == 1 and len(set(p["slice"][mine & p["asks"]])) == 1


def test_products_of_codes_are_whole():
    rng = np.random.default_rng(9)
    a, b = rng.integers(-127, 128, (20, 2500)).astype(np.int8), np.full((5, 2500), 127, dtype=np.int8)
    assert np.array_equal(nearest.int8_products(a, b).astype(np.int64), a.astype(np.int64) @ b.astype(np.int64).T)


def test_tile_equals_brute_force_on_wide_vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 384)).astype(np.float32)
    x[7] = x[9]
    ids = rng.permutation(1000)[:300].astype(np.int64)
    who, far = nearest.nearest_in_tile(x, ids, x, ids, 10)
    for a in range(300):
        d = ((x.astype(float) - x[a]) ** 2).sum(1)
        d[a] = np.inf
        assert who[a].tolist() == ids[np.lexsort((ids, d))[:10]].tolist()


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0, 0.0, 0.0])], [(1, None)]])
def test_empty_and_single(spark, rows):
    assert found(spark, rows) == set()
