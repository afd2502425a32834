"""Problem 8: fill fixed-capacity containers, by non-negative least squares over shallow length combinations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import wordpunct_count
from quire.plans.prefix import prefix_sums
from quire.plans.storage import staged

Plan = list[tuple[list[tuple[int, int]], int]]


def patterns(hist: np.ndarray, window: int, most: int = 4000) -> list[list[tuple[int, int]]]:
    """Shallow combinations (one to three different lengths, each as often as it fits) that fill the capacity up
    to ``window`` tokens.  ``most`` bounds how many columns the least-squares problem gets."""
    cap = len(hist) - 1
    have = [int(x) for x in np.flatnonzero(hist[1:]) + 1]
    present = np.zeros(cap + 1, dtype=bool)
    present[have] = True
    out: dict[tuple, None] = {}

    def near(room: int) -> int:
        for x in range(room, max(0, room - window - 1), -1):
            if present[x]:
                return x
        return 0

    by_mass = sorted(have, key=lambda x: (-int(hist[x]) * x, x))
    for a in sorted(have, reverse=True):
        for times in range(1, cap // a + 1):
            room = cap - a * times
            if room <= window:
                out.setdefault(((a, times),))
            elif (b := near(room)) and b != a:
                out.setdefault(tuple(sorted(((a, times), (b, 1)), reverse=True)))
            if times >= 6:
                break
    for a in by_mass[:200]:
        for b in by_mass[:60]:
            if len(out) >= most:
                break
            room = cap - a - b
            if b < a and room > 0 and (c := near(room)) and c not in (a, b):
                out.setdefault(tuple(sorted(((a, 1), (b, 1), (c, 1)), reverse=True)))
    return [list(p) for p in out][:most]


def nnls(columns: list[list[tuple[int, int]]], target: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """Cyclic coordinate descent for min |A x - target|, x >= 0, A given by sparse columns."""
    x = np.zeros(len(columns))
    residual = target.astype(float).copy()
    weights = [np.array([p[1] for p in c], float) for c in columns]
    places = [np.array([p[0] for p in c]) for c in columns]
    norms = [float((w * w).sum()) for w in weights]
    for _ in range(sweeps):
        moved = 0.0
        for j, (p, w) in enumerate(zip(places, weights)):
            step = max(-x[j], float(w @ residual[p]) / norms[j])
            if step:
                x[j] += step
                residual[p] -= step * w
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return x


def plan_containers(hist: np.ndarray, window: int = 8) -> Plan:
    """Container patterns with repeat counts that use up the histogram of lengths exactly.

    ``hist[l]`` is the number of items of length l, up to the capacity ``len(hist) - 1``.  The size of the plan is
    bounded by the capacity, not by the number of items.
    """
    left = hist.astype(np.int64).copy()
    cap = len(hist) - 1
    plan: Plan = []
    columns = patterns(left, window)
    if columns:
        wanted = np.floor(nnls(columns, left) + 0.5).astype(np.int64)
        for j in sorted(range(len(columns)), key=lambda j: (-sum(a * b for a, b in columns[j]), -columns[j][0][0])):
            n = min([int(wanted[j]), *(int(left[p]) // t for p, t in columns[j])])
            if n > 0:
                plan.append((columns[j], n))
                for p, t in columns[j]:
                    left[p] -= n * t
    while left[1:].any():  # what rounding left over: largest first, each room filled with the largest that fits
        room, used = cap, []
        while room > 0 and (fit := np.flatnonzero(left[1 : room + 1])).size:
            length = int(fit[-1]) + 1
            times = min(room // length, int(left[length]))
            used.append((length, times))
            left[length] -= times
            room -= times * length
        again = min([int(left[p]) // t for p, t in used])
        for p, t in used:
            left[p] -= again * t
        plan.append((used, 1 + again))
    return plan


def _place(places: dict[int, list[tuple[int, int, int]]]) -> Callable:
    """The container of the rank-th piece of a length: the last run of places that begins at or before it."""
    tables = {length: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for length, rows in places.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rank = batch.column("tokens").to_numpy(), batch.column("nth").to_numpy() - 1
            out = np.zeros(len(rank), dtype=np.int64)
            for length in np.unique(tokens):
                start, container, per = tables[int(length)]
                mine = tokens == length
                at = np.searchsorted(start, rank[mine], side="right") - 1
                out[mine] = container[at] + (rank[mine] - start[at]) // per[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "n_pieces", "tokens")), pa.array(out)], ["doc_id", "piece", "n_pieces", "tokens", "container"])

    return run


def pack(documents: DataFrame, capacity: int = 1024, window: int = 8) -> DataFrame:
    """Put every document into containers of ``capacity`` wordpunct tokens.

    A document of at most ``capacity`` tokens stays whole; a longer one is cut into full pieces and a rest.  The
    histogram of piece lengths (``capacity`` numbers, whatever the data) is matched by repeat counts of shallow
    combinations, found by non-negative least squares, rounded, and the residual is packed greedily.  Pieces of
    one length are numbered by distributed prefix sums, so no length is gathered in one task, and the k-th takes the k-th
    place the plan has for that length.

    Result: doc_id, piece, n_pieces, tokens, container.  Documents without tokens (null or empty text) need no
    room: one row with piece 0, n_pieces 0, tokens 0 and a null container.  Repeated rows are packed each.
    """
    docs = documents.select(F.col("doc_id"), F.coalesce(wordpunct_count(F.col("text")), F.lit(0)).cast("long").alias("size"))
    docs = staged(docs.withColumn("n_pieces", F.ceil(F.col("size") / F.lit(float(capacity))).cast("int")), "sizes")
    items = docs.filter("size > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    items = items.withColumn("tokens", F.when(F.col("piece") < F.col("n_pieces") - 1, F.lit(capacity)).otherwise(F.col("size") - F.col("piece").cast("long") * capacity).cast("int"))
    items = items.select("doc_id", "piece", "n_pieces", "tokens", F.lit(1).alias("one"))
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in items.groupBy("tokens").agg(F.count("*").alias("n")).collect():  # capacity rows at most
        hist[r.tokens] = r.n
    places: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    container = 0
    for combo, times in plan_containers(hist, window):
        for length, per in combo:
            start = used.get(length, 0)
            places.setdefault(length, []).append((start, container, per))
            used[length] = start + per * times
        container += times
    ranked = prefix_sums(items, ["tokens"], ["doc_id", "piece"], "one", "nth").drop("one")
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = ranked.mapInArrow(_place(places), f"doc_id {kind}, piece int, n_pieces int, tokens int, container long")
    none = docs.filter("size = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_pieces"), F.lit(0).alias("tokens"), F.lit(None).cast("long").alias("container"))
    return placed.unionByName(none)
