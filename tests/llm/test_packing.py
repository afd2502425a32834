import re

import numpy as np
import pytest

from quire.llm import packing


def size(text):
    return len(re.findall(r"\w+|[^\w\s]+", text or ""))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plan_uses_the_histogram_exactly_and_fills_well(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(1025, dtype=np.int64)
    for x in np.clip(rng.lognormal(5.3, 0.8, 20_000).astype(int), 1, 1024):
        hist[x] += 1
    used, n, total = np.zeros(1025, dtype=np.int64), 0, 0
    for combo, times in packing.plan_containers(hist):
        assert sum(a * b for a, b in combo) <= 1024 and times > 0
        n += times
        for a, b in combo:
            used[a] += b * times
    assert (used == hist).all()
    total = int((hist * np.arange(1025)).sum())
    assert n * 1024 <= 1.01 * total + 1024


def test_pack(spark):
    texts = ["a " * k for k in (10, 500, 514, 1024, 1025, 3000, 1, 1)] + [None, "", "  \n", "x,y!! _z9"] + ["b " * 100] * 30
    df = spark.createDataFrame([(n, t, 1, 2) for n, t in enumerate(texts)] + [(0, texts[0], 1, 2)], "doc_id long, text string, container int, nth int")
    rows = packing.pack(df).collect()
    sizes = {}
    for r in rows:
        if r.container is not None:
            sizes[r.container] = sizes.get(r.container, 0) + r.tokens
    assert max(sizes.values()) <= 1024
    per = {}
    for r in rows:
        per.setdefault(r.doc_id, []).append(r)
    for n, t in enumerate(texts):
        mine = [r for r in per[n]]
        copies = 2 if n == 0 else 1
        assert sum(r.tokens for r in mine) == size(t) * copies
        whole = size(t) <= 1024
        assert all((r.n_pieces <= 1) == whole for r in mine)
    assert {r.doc_id for r in rows if r.n_pieces > 1} == {4, 5}
    assert {r.doc_id for r in rows if r.container is None} == {8, 9, 10}


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
