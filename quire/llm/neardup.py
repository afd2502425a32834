"""Problem 6: near-duplicate records, by adaptive multi-match prefixes.

A record is the set of its w-term shingles.  All records order their shingles alike, those that occur often last.
Two records of similarity t or more (shared / union) share at least ceil(t / (1 + t) * (|x| + |y|)) shingles, so
they share at least m of the first |x| - overlap + m of x and |y| - overlap + m of y, for any m.  Each record
chooses its m: it lengthens its prefix while the next shingles are cheap (few records hold them) and in return
asks for as many more shared prefix shingles before a pair is verified.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.storage import staged, width

_TERM = re.compile(r"[^\W_]+")


class _Hashes(dict):
    """64-bit hash of each term, computed when it is first asked for."""

    def __missing__(self, term: str) -> int:
        code = self[term] = xxhash.xxh64_intdigest(term)
        return code


_WORDS = _Hashes()
#: In a cell of a cut posting list: records of one slice, of the lower of two, of the upper of two.
SAME, LEFT, RIGHT = 0, 1, 2


def shingle_sets(texts: list[str | None], w: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the w-term shingles of each text."""
    if len(_WORDS) > 400_000:
        _WORDS.clear()
    out = []
    for text in texts:
        found = _TERM.findall(text.lower()) if text else ()
        part = np.fromiter(map(_WORDS.__getitem__, found), dtype=np.uint64, count=len(found))
        if len(part) < w:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        n = len(part) - w + 1
        h = np.full(n, 0x243F6A8885A308D3, dtype=np.uint64)
        for k in range(w):
            h = (h ^ part[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append(np.unique(h))
    return out


class Sketch:
    """Counters of fixed size for how often shingles occur: three rows of ``SLOTS``, a shingle counts in one slot of each.

    The estimate is the middle one of its three counters, each less the mean of the other slots.  It is off by about
    sqrt(total / SLOTS) (110 for 6.5 billion shingles), so what is frequent is told from what is rare at any size.
    """

    ROWS, SLOTS = 3, 1 << 19
    _MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

    def __init__(self, counters: np.ndarray | None = None) -> None:
        self.counters = np.zeros((self.ROWS, self.SLOTS), dtype=np.int64) if counters is None else counters

    def _slots(self, shingles: np.ndarray, row: int) -> np.ndarray:
        return ((shingles * np.uint64(self._MIX[row])) >> np.uint64(64 - 19)).astype(np.int64)

    def add(self, shingles: np.ndarray) -> None:
        for row in range(self.ROWS):
            self.counters[row] += np.bincount(self._slots(shingles, row), minlength=self.SLOTS)

    def estimate(self, shingles: np.ndarray) -> np.ndarray:
        x, y, z = (self.counters[row][self._slots(shingles, row)] for row in range(self.ROWS))
        seen = np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))
        other = (int(self.counters[0].sum()) - seen) // (self.SLOTS - 1)
        return np.maximum(0, seen - other)

    def pack(self) -> bytes:
        return zlib.compress(self.counters.tobytes(), 1)

    @classmethod
    def unpack(cls, raw: bytes) -> Sketch:
        return cls(np.frombuffer(zlib.decompress(raw), dtype=np.int64).reshape(cls.ROWS, cls.SLOTS).copy())


def _survey(w: int) -> Callable:
    """One pass, two kinds of rows: (id, size, a, b), size and 128 bits of each record's shingle set; and one row per
    task with the counts of its shingles."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, names = Sketch(), ["id", "size", "a", "b", "sketch"]
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), w)
            if not sets:
                continue
            sums = [(xxhash.xxh64_intdigest(s.tobytes(), 1) - (1 << 63), xxhash.xxh64_intdigest(s.tobytes(), 2) - (1 << 63)) for s in sets]
            counts.add(np.concatenate(sets))
            cols = [batch.column(0), [len(s) for s in sets], [x[0] for x in sums], [x[1] for x in sums]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, kinds)], pa.nulls(len(sets), pa.binary())], names)
        if counts.counters[0].any():
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in kinds[:4]], pa.array([counts.pack()], pa.binary())], names)

    return run


def _merge_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = Sketch()
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            whole.counters += Sketch.unpack(raw).counters
    yield pa.RecordBatch.from_arrays([pa.array([whole.pack()], pa.binary())], ["sketch"])


def merged_sketch(rows: DataFrame, at_once: int = 32) -> Sketch:
    """The sum of the sketches in ``rows`` (one binary column): tasks add ``at_once`` of them, until one is left."""
    n = rows.count()
    if not n:
        return Sketch()
    while True:
        tasks = -(-n // at_once)
        rows = staged(rows.repartition(tasks).mapInArrow(_merge_sketches, "sketch binary"), "sketch")
        if tasks == 1:
            return Sketch.unpack(bytes(rows.first().sketch))
        n = tasks


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity bitmap of a shingle set, of the least power of two of bits that is twice the set's size, 64 at least.

    Two sets' bitmaps differ in at most as many bits as the sets differ in shingles; a longer bitmap becomes a
    shorter one by xor of its halves."""
    bits = 64
    while bits < 2 * len(s):
        bits *= 2
    at = ((s >> np.uint64(17)) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(at, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _differ(maps: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the bitmaps of records a and b (places in ``maps``) differ, at the shorter one's length."""
    words = np.array([len(m) for m in maps])
    short = np.minimum(words[a], words[b])
    out = np.zeros(len(a), dtype=np.int64)
    for length in np.unique(short):
        of = np.flatnonzero(short == length)
        need = np.unique(np.concatenate([a[of], b[of]]))
        table = np.zeros((len(need), length), dtype=np.uint64)
        for k, d in enumerate(need):
            m = maps[d]
            while len(m) > length:
                m = m[: len(m) // 2] ^ m[len(m) // 2 :]
            table[k] = m
        x, y = np.searchsorted(need, a[of]), np.searchsorted(need, b[of])
        step = max(1, 4_000_000 // int(length))
        for lo in range(0, len(of), step):
            out[of[lo : lo + step]] = np.bitwise_count(table[x[lo : lo + step]] ^ table[y[lo : lo + step]]).sum(1)
    return out


def multi_match(size: int, counts: np.ndarray, t: float, cheap: int, least: int = 3, part: int = 20) -> int:
    """How many prefix shingles a record may ask a partner to share: ``least``, and one more for each further shingle
    of its prefix that is met at most ``cheap`` times, up to ``least`` and a ``part``-th of the record.

    A pair that is verified without need costs as much as some thousand pairs met in posting lists, so the first
    ``least`` are worth any list.  ``counts`` are the estimates of the record's shingles in prefix order."""
    base = size - int(np.ceil(t * size)) + least
    more = counts[base : base + size // part]
    stop = np.flatnonzero(more > cheap)
    return max(1, min(least, size) + int(stop[0] if len(stop) else len(more)))


def _postings(w: int, t: float, sketch: Sketch, buckets: int, cheap: int, hot: int) -> Callable:
    """Prefix postings, packed by bucket: one row per (bucket, batch) with little-endian arrays.

    A posting is its shingle's code, its place in the record's order and its record; records are listed once a row, with
    their size and, in the top byte, how many matches they ask for (255 at most).  The postings of a shingle met more
    than ``hot`` times are cut into slices by record; slice i goes to the cells (i, j) of every j, so that no task gets
    them all.  The cell's side is kept in the top byte of ``pos``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            hs, ds, ps, meta = [], [], [], []
            more_h, more_d, more_p = [], [], []
            sets = shingle_sets(batch.column(1).to_pylist(), w)
            if not sets:
                continue
            every = sketch.estimate(np.concatenate(sets))
            at = 0
            for k, s in enumerate(sets):
                size = len(s)
                if size >= 1 << 24:
                    raise ValueError("a record of more than 16 million shingles")
                e = every[at : at + size]
                at += size
                order = np.lexsort((s, e))
                s, e = s[order], e[order]
                m = min(255, multi_match(size, e, t, cheap)) if size else 0
                cut = min(size, size - int(np.ceil(t * size)) + m) if size else 0
                hs.append(s[:cut])
                ds.append(np.full(cut, k, dtype=np.int32))
                ps.append(np.arange(cut, dtype=np.int32))
                meta.append(size | m << 24)
            h, d, p = np.concatenate(hs), np.concatenate(ds), np.concatenate(ps)
            meta = np.array(meta, dtype=np.uint32)
            p |= SAME << 24
            heavy = sketch.estimate(h)
            for at in np.flatnonzero(heavy > hot):
                slices = int(-(-heavy[at] // hot))
                mine = xxhash.xxh64_intdigest(int(ids[d[at]]).to_bytes(8, "little", signed=True)) % slices
                cells = [(min(mine, j), max(mine, j)) for j in range(slices)]
                named = [xxhash.xxh64_intdigest(f"{h[at]} {i} {j}") for i, j in cells]
                side = [(SAME if i == j else LEFT if i == mine else RIGHT) << 24 for i, j in cells]
                place = p[at] & 0xFFFFFF
                h[at], p[at] = named[0], place | side[0]
                more_h.append(np.array(named[1:], dtype=np.uint64))
                more_d.append(np.full(slices - 1, d[at], dtype=np.int32))
                more_p.append(place | np.array(side[1:], dtype=np.int32))
            h, d, p = np.concatenate([h, *more_h]), np.concatenate([d, *more_d]), np.concatenate([p, *more_p])
            b = (h % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(b, kind="stable")
            h, d, p, b = h[order], d[order], p[order], b[order]
            edges = np.flatnonzero(np.diff(b)) + 1
            cols: list[list] = [[], [], [], [], [], []]
            for lo, hi in zip([0, *edges], [*edges, len(b)]):
                if lo == hi:
                    continue
                docs, local = np.unique(d[lo:hi], return_inverse=True)
                code = (h[lo:hi] // np.uint64(buckets)).astype(np.uint32)
                cols[0].append(int(b[lo]))
                for c, x in zip(cols[1:], (code, local.astype(np.uint16 if len(docs) <= 1 << 16 else np.uint32), p[lo:hi], ids[docs].astype(np.int64), meta[docs])):
                    c.append(x.tobytes())
            kinds = [pa.int32(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["bucket", "code", "local", "pos", "ids", "meta"])

    return run


def _pairs_of(t: float, block: int = 1024) -> Callable:
    """Pairs of a bucket that share a prefix shingle early enough for both, with how many they share here."""

    def run(batch: pa.Table) -> pa.Table:
        code, pos, doc, size, ask = [], [], [], [], []
        for r in batch.to_pylist():
            code.append(np.frombuffer(r["code"], dtype=np.uint32))
            local = np.frombuffer(r["local"], dtype=np.uint16 if len(r["local"]) == 2 * len(code[-1]) else np.uint32)
            pos.append(np.frombuffer(r["pos"], dtype=np.int32))
            doc.append(np.frombuffer(r["ids"], dtype=np.int64)[local])
            meta = np.frombuffer(r["meta"], dtype=np.uint32)[local].astype(np.int64)
            size.append(meta & 0xFFFFFF)
            ask.append(meta >> 24)
        c, p, d, n, m = (np.concatenate(x) for x in (code, pos, doc, size, ask))
        order = np.lexsort((d, c))
        c, p, d, n, m = c[order], p[order], d[order], n[order], m[order]
        side, p = p >> 24, p & 0xFFFFFF
        starts = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1, [len(c)]])
        lengths = np.diff(starts)
        out_a, out_b, out_k, out_need, out_sum = [], [], [], [], []

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            k = np.minimum(m[i], m[j])
            overlap = np.ceil(t / (1 + t) * (n[i] + n[j]) - 1e-9).astype(np.int64)
            ok = (p[i] < n[i] - overlap + k) & (p[j] < n[j] - overlap + k) & (np.minimum(n[i], n[j]) >= t * np.maximum(n[i], n[j]) - 1e-9) & (d[i] != d[j]) & ((side[i] != side[j]) | (side[i] == SAME))
            i, j = i[ok], j[ok]
            swap = d[i] > d[j]
            out_a.append(np.where(swap, d[j], d[i]))
            out_b.append(np.where(swap, d[i], d[j]))
            out_need.append(k[ok])

        for length in np.unique(lengths):  # lists of one length are paired together
            if length < 2:
                continue
            first = starts[:-1][lengths == length]
            if length <= 64:
                x, y = np.triu_indices(length, 1)
                step = max(1, 2_000_000 // len(x))
                for at in range(0, len(first), step):
                    f = first[at : at + step, None]
                    keep((f + x).ravel(), (f + y).ravel())
            else:
                for f in first:
                    for lo in range(0, length, block):
                        for lo2 in range(lo, length, block):
                            i = np.arange(lo, min(lo + block, length))
                            j = np.arange(lo2, min(lo2 + block, length))
                            gi, gj = np.repeat(i, len(j)), np.tile(j, len(i))
                            if lo == lo2:
                                less = gi < gj
                                gi, gj = gi[less], gj[less]
                            keep(f + gi, f + gj)
        if not out_a:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "shared": pa.array([], pa.int32()), "need": pa.array([], pa.int32())})
        a, b, need = np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_need)
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        new = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0)]) if len(a) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        times = np.diff(np.concatenate([at, [len(a)]]))
        return pa.table({"a": a[at], "b": b[at], "shared": times.astype(np.int32), "need": need[at].astype(np.int32)})

    return run


def _sets(w: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), w)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "size", "map", "shingles"])

    return run


def _may_be_similar(t: float) -> Callable:
    """Pairs whose bitmaps do not differ in more bits than similar sets may differ in shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            maps = [np.frombuffer(m, dtype=np.uint64) for c in ("x", "y") for m in batch.column(c).to_pylist()]
            both = batch.column("nx").to_numpy() + batch.column("ny").to_numpy()
            alike = _differ(maps, np.arange(n), n + np.arange(n)) <= both - 2 * np.ceil(t / (1 + t) * both - 1e-9) if n else np.zeros(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(alike))

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sims = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            shared = len(np.intersect1d(p, q, assume_unique=True))
            sims.append(shared / (len(p) + len(q) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["a", "b", "similarity"])


def without(df: DataFrame, ids: DataFrame, key: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose key is not in the staged ``ids``; broadcast only if that has at most so many rows."""
    return df.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, key, "left_anti")


def within(df: DataFrame, ids: DataFrame, key: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose key is in the staged ``ids``; broadcast only if that has at most so many rows."""
    return df.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, key, "left_semi")


def near_duplicates(records: DataFrame, key: str = "doc_id", text: str | Column = "text", threshold: float = 0.8, w: int = 5, cheap: int = 1_000, hot: int = 20_000, bucket_postings: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """Records whose sets of w consecutive terms have at least ``threshold`` of their union in common.

    Records with equal sets are one class, represented by its smallest key, so copies are never compared.  How often
    shingles occur is counted over all records in a ``Sketch``, whose size does not depend on the collection; it orders
    shingles, tells what a longer prefix costs and which posting lists to cut, and affects the cost, never the result.
    There is one bucket per ``bucket_postings`` postings or so.  Pairs that share enough prefix shingles are tried on
    their bitmaps, which are sent once for each record in such a pair, and what is left on the sets.

    Returns (members, pairs): members has (id, rep) of every record with a non-empty set; pairs has
    (a, b, similarity) of the representatives of similar classes, a < b.  Null or short texts have no shingles and
    are in neither.  Repeated keys count once.
    """
    column = F.col(text) if isinstance(text, str) else text
    docs = records.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), column.alias("text")).filter("text is not null")
    spark = records.sparkSession
    survey = staged(docs.mapInArrow(_survey(w), "id long, size int, a long, b long, sketch binary"), "survey")
    signed = survey.filter("size > 0").select("id", "size", "a", "b")
    classes = signed.groupBy("a", "b").agg(F.min("id").alias("rep"), F.max("size").alias("size"), F.count("*").alias("n"))
    copies = classes.filter("n > 1").select("a", "b", "rep")
    others = staged(signed.select("id", "a", "b").join(copies, ["a", "b"]).filter("id != rep").select("id", "rep").distinct(), "copies")
    sketch = merged_sketch(survey.filter("sketch is not null").select("sketch"))
    total = int(sketch.counters[0].sum())
    reps = without(docs, others.select("id"), "id")
    buckets = max(width(spark), int(total * min(1.0, 1.17 - threshold) // bucket_postings) + 1)
    packed = reps.mapInArrow(_postings(w, threshold, sketch, buckets, cheap, hot), "bucket int, code binary, local binary, pos binary, ids binary, meta binary")
    found = packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_pairs_of(threshold), "a long, b long, shared int, need int")
    cand = found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).filter("shared >= need").select("a", "b")
    cand = staged(cand, "candidates")
    wanted = staged(cand.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    sets = staged(within(reps, wanted, "id").dropDuplicates(["id"]).mapInArrow(_sets(w), "id long, size long, map binary, shingles binary"), "sets")
    one, two = sets.select(F.col("id").alias("a"), F.col("map").alias("x"), F.col("size").alias("nx")), sets.select(F.col("id").alias("b"), F.col("map").alias("y"), F.col("size").alias("ny"))
    left = staged(cand.join(one, "a").join(two, "b").select("a", "b", "x", "y", "nx", "ny").mapInArrow(_may_be_similar(threshold), "a long, b long"), "alike")
    one, two = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    pairs = left.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long, similarity double").filter(F.col("similarity") >= threshold - 1e-12)
    members = signed.select("id").distinct().join(others, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return members, pairs


def with_short(members: DataFrame, records: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``members`` and the records without a set: equal texts are one class, a null text is one of its own."""
    ids = records.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.sha2(F.col(text), 256).alias("h"))
    short = ids.join(members.select("id"), "id", "left_anti").groupBy("id").agg(F.min("h").alias("h"))  # repeated keys count once
    reps = short.filter("h is not null").groupBy("h").agg(F.min("id").alias("rep"))
    return members.unionByName(short.join(reps, "h", "left").select("id", F.coalesce("rep", "id").alias("rep")))


def expand_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b) of all similar records, copies included, the smaller key first."""
    pairs = staged(pairs.select("a", "b"), "pairs")
    m = staged(members, "members")
    more = m.groupBy("rep").count().filter("count > 1").select("rep")
    copies = m.join(more, "rep")
    same = copies.alias("x").join(copies.alias("y"), "rep").filter("x.id < y.id").select(F.col("x.id").alias("p"), F.col("y.id").alias("q"))
    left = m.select(F.col("rep").alias("a"), F.col("id").alias("p"))
    right = m.select(F.col("rep").alias("b"), F.col("id").alias("q"))
    other = pairs.join(left, "a").join(right, "b").select("p", "q")
    return same.unionByName(other).select(F.least("p", "q").alias("doc_id_a"), F.greatest("p", "q").alias("doc_id_b"))


def groups(members: DataFrame, pairs: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected groups: id, group (smallest key in it), links (similar classes and copies of the record).

    Labels spread by large-star and small-star steps between written tables; ``rounds`` steps that do not settle
    raise an error.  Every record with a non-empty set has a row.
    """
    pairs = staged(pairs.select("a", "b"), "links")
    edges = pairs
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").union(low.select("a", F.col("m").alias("b"))).distinct()
        small = staged(small, "stars")
        settled = small.groupBy("a").count().filter("count > 1").isEmpty() and small.join(small.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        edges = small
        if settled:
            break
    else:
        raise RuntimeError("the groups did not settle")
    label = edges.select(F.col("a").alias("rep"), F.col("b").alias("group"))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("classes"))
    size = members.groupBy("rep").agg(F.count("*").alias("copies"))
    out = members.join(label, "rep", "left").join(degree, "rep", "left").join(size, "rep")
    return out.select("id", F.coalesce("group", "rep").alias("group"), (F.coalesce("classes", F.lit(0)) + F.col("copies") - 1).alias("links"))
