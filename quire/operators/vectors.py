"""Exact nearest neighbours of a query set, in blocks, and the deterministic bag-of-words embedder."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.plans.storage import staged

_WORD = re.compile(r"[^\W_]+")

FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def usable(vectors: DataFrame, dim: int = 384) -> DataFrame:
    """One row per chunk_rowid with ``dim`` finite numbers, not all zero."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("chunk_rowid").isNotNull() & (F.size(e) == dim) & ~bad & F.exists(e, lambda x: x != 0)
    return vectors.filter(ok).groupBy("chunk_rowid").agg(F.min("embedding").alias("embedding"), F.min("document_id").alias("document_id"))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda s, x: s + x))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), -1)


class _Best:
    """The k nearest rows met so far of every query of a block."""

    def __init__(self, queries: np.ndarray, k: int, bound: np.ndarray | None = None) -> None:
        self.q, self.k, self.bounded = queries.astype(np.float32), k, bound is not None
        self.own = (self.q.astype(np.float64) ** 2).sum(1)
        self.limit = np.full(len(queries), np.inf) if bound is None else (bound + 2e-9) ** 2
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def meet(self, which: np.ndarray, ids: np.ndarray, x: np.ndarray, rows: int = 2_048) -> None:
        """Queries ``which`` meet all rows of ``x``.  Products are in float32; what may be among the k by them is
        computed again in float64."""
        for lo in range(0, len(x), rows):
            y = x[lo : lo + rows]
            own = (y.astype(np.float64) ** 2).sum(1)
            near = self.q[which] @ y.T
            near -= (own / 2).astype(np.float32)[None]  # the squared distance is the query's own square less twice this
            slack = 1e-5 * (1 + self.own[which] + own.max(initial=0.0))
            limit = self.limit[which]
            if len(y) >= self.k and not self.bounded:
                limit = np.minimum(limit, self.own[which] - 2.0 * np.partition(near, len(y) - self.k, axis=1)[:, len(y) - self.k])
            i, j = np.nonzero(near >= ((self.own[which] - limit - slack) / 2).astype(np.float32)[:, None])
            d = np.empty(len(i))
            for a in range(0, len(i), 16_384):
                gap = self.q[which[i[a : a + 16_384]]].astype(np.float64) - y[j[a : a + 16_384]]
                d[a : a + 16_384] = np.einsum("ij,ij->i", gap, gap)
            self.rows.append((which[i], ids[lo + j], np.sqrt(d)))
            self.held += len(i)
            if self.held > 4 * self.k * len(self.q) + 100_000:
                self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, n, d = (np.concatenate(c) for c in zip(*self.rows)) if self.rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((n, np.round(d, 9), q))
        q, n, d = q[order], n[order], d[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        last = nth == self.k - 1
        self.limit[q[last]] = np.minimum(self.limit[q[last]], d[last] ** 2)
        keep = nth < self.k
        self.rows, self.held = [(q[keep], n[keep], d[keep])], int(keep.sum())
        return self.rows[0]


def _scan(block: list, k: int, within: str | None, bound: np.ndarray | None = None):
    """One pass over the vectors for a block of queries: each task keeps its own k best of every query.  With ``bound``, a
    distance for each query, only those up to it (and a rounding beyond), with whether they are within it."""
    ids = np.array([r.question_id for r in block], dtype=np.int64)
    queries = np.array([r.query for r in block], dtype=np.float32)
    of: dict = {}
    if within:
        for n, r in enumerate(block):
            of.setdefault(r.bound, []).append(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(queries, k, bound)
        everyone = np.arange(len(ids))
        for batch in batches:
            if not len(batch):
                continue
            vid, x = batch.column("id").to_numpy(), _matrix(batch.column("embedding"))
            if not within:
                best.meet(everyone, vid, x)
                continue
            coded = batch.column(within).dictionary_encode()
            code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for c, value in enumerate(coded.dictionary.to_pylist()):
                if value in of:  # only vectors of the value meet the queries of it
                    at = np.flatnonzero(code == c)
                    best.meet(np.array(of[value]), vid[at], x[at])
        q, n, d = best.shrink()
        if bound is not None:
            keep = d <= bound[q] + 2e-9
            q, n, d = q[keep], n[keep], d[keep]
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(n), pa.array(d), pa.array(d <= bound[q])], ["question_id", "id", "distance", "sure"])
            return
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(n), pa.array(d)], ["question_id", "id", "distance"])

    return run


def _bounded(rows: list, v: DataFrame, k: int, block: int, sample: int) -> tuple[DataFrame, list]:
    """(question_id, id, distance) of all vectors up to a distance guessed from every ``sample``-th vector, for the queries
    that have k of them; and the other queries."""
    m = math.ceil(k / sample + 4 * math.sqrt(k / sample)) + 4
    some = v.filter(F.pmod(F.xxhash64("id"), F.lit(sample)) == 0)
    scans = [some.mapInArrow(_scan(rows[at : at + block], m, None), NEIGHBOURS) for at in range(0, len(rows), block)]
    guess = {r.question_id: r.distance for r in _nearest(reduce(DataFrame.unionByName, scans), m).filter(F.col("rank") == m).select("question_id", "distance").collect()}
    bound = np.array([guess.get(r.question_id, np.inf) for r in rows])
    scans = [v.mapInArrow(_scan(rows[at : at + block], k, None, bound[at : at + block]), NEIGHBOURS + ", sure boolean") for at in range(0, len(rows), block)]
    near = staged(reduce(DataFrame.unionByName, scans), "near")
    enough = near.filter("sure").groupBy("question_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("question_id")
    known = {r.question_id for r in enough.collect()}
    return near.join(enough, "question_id", "left_semi").drop("sure"), [r for r in rows if r.question_id not in known]


def _nearest(parts: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("question_id").orderBy(F.round("distance", 9), "id"))
    return parts.withColumn("rank", nth).filter(F.col("rank") <= k)


NEIGHBOURS = "question_id long, id long, distance double"


def knn(queries: DataFrame, vectors: DataFrame, k: int, within: str | None = None, block: int = 2_048, most_blocks: int = 16, slice_rows: int = 16_384, sample: int = 0) -> DataFrame:
    """(question_id, id, distance, rank): the k nearest vectors of every query, exactly.

    ``queries`` has (question_id, embedding), ``vectors`` (id, embedding), both with ``within`` where the search is
    bound to equal values of it.  Queries go out in blocks of ``block`` to where the vectors are, every task keeps its k
    best, and these are merged, so no vector is shuffled and a task's memory depends on neither number.  Beyond
    ``most_blocks`` blocks the driver holds no queries: blocks and slices of about ``slice_rows`` vectors are brought
    together instead.  Distances are L2; ties go to the smaller id.  With ``sample``, for vectors that are cheap to read
    again, every so manieth vector tells about how far a query's k nearest reach, so that not each task passes on k; the
    queries that have fewer than k vectors there are searched without.
    """
    own = [within] if within else []
    q = staged(queries.select("question_id", F.col("embedding").alias("query"), *[F.col(c).alias("bound") for c in own]), "queries")
    n_blocks = -(-q.count() // block)
    v = vectors.select("id", "embedding", *own)
    out = NEIGHBOURS
    if n_blocks <= most_blocks:
        rows = q.collect()  # block * most_blocks at most
        parts = None
        if sample and rows and not within and v.count() >= 4 * sample * k:
            parts, rows = _bounded(rows, v, k, block, sample)
            if not rows:
                return _nearest(parts, k)
        for at in range(0, max(1, len(rows)), block):
            one = v.mapInArrow(_scan(rows[at : at + block], k, within), out) if rows else v.sparkSession.createDataFrame([], out)
            parts = one if parts is None else parts.unionByName(one)
    else:
        slices = max(1, -(-v.count() // slice_rows))
        left = q.withColumn("block", F.pmod(F.xxhash64("question_id"), F.lit(n_blocks))).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        right = v.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            rows = [SimpleNamespace(**r) for r in a.to_pylist()]
            got = list(_scan(rows, k, within)(iter(b.combine_chunks().to_batches()))) if rows else []
            return pa.Table.from_batches(got, pa.schema([("question_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())]))

        parts = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(meet, out)
    return _nearest(parts, k)


def fnv1a(token: Column) -> Column:
    """32-bit FNV-1a over a token's characters."""
    return F.aggregate(F.split(token, ""), F.lit(FNV_OFFSET).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)))


def stub_buckets(texts: DataFrame, key: str, text: str, dim: int = 384) -> DataFrame:
    """(key, bucket, weight): the non-zero places of the bag-of-words embedding, scaled to length 1."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    counted = texts.select(key, F.explode(words).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    buckets = counted.groupBy(key, F.pmod(fnv1a(F.col("w")), F.lit(dim)).cast("int").alias("bucket")).agg(F.sum("n").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return buckets.select(key, "bucket", (F.col("n") / norm).alias("weight"))


class StubEmbedder:
    """The deterministic bag-of-words embedder: every word counts at the place its FNV-1a hash names; length 1.

    Any object with ``name``, ``dim`` and ``embed(texts) -> array`` can take its place; ``query_prefix`` goes before a
    question."""

    name, dim, query_prefix = "stub-fnv1a-384", 384, ""

    def __init__(self) -> None:
        self.places: dict[str, int] = {}

    def place(self, word: str) -> int:
        got = self.places.get(word)
        if got is None:
            h = FNV_OFFSET
            for c in word:
                h = ((h ^ ord(c)) * FNV_PRIME) & 0xFFFFFFFF
            if len(self.places) > 1_000_000:
                self.places.clear()
            got = self.places[word] = h % self.dim
        return got

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for k, text in enumerate(texts):
            found = [self.place(w) for w in _WORD.findall(text.lower())]
            out[k] = np.bincount(found, minlength=self.dim) if found else 0
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)).astype(np.float32)


def embed(texts: DataFrame, key: str, text: str, embedder: object | None = None, batch: int = 64) -> DataFrame:
    """(key, embedding) of every text by an embedder, ``batch`` at a time in one pass; null counts as empty.  An embedder
    that does not give one vector of its dimension for each text raises an error."""
    maker = embedder or StubEmbedder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            given = [t or "" for t in rows.column(1).to_pylist()]
            for at in range(0, len(given), batch):
                got = np.asarray(maker.embed(given[at : at + batch]), dtype=np.float32)
                if got.shape != (len(given[at : at + batch]), maker.dim):
                    raise ValueError(f"{maker.name} gave {got.shape} for {len(given[at : at + batch])} texts")
                offsets = pa.array(np.arange(len(got) + 1) * maker.dim, pa.int32())
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(at, len(got)), pa.ListArray.from_arrays(offsets, pa.array(got.ravel()))], [key, "embedding"])

    return texts.select(key, text).mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, embedding array<float>")


def stub_embed(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, embedding) by the bag-of-words embedder; a text without words gives all zeros."""
    return embed(texts, key, text)


def embed_input(title: Column, path: Column, overlap: Column, text: Column) -> Column:
    """What is embedded of a chunk: title, section trail, overlap and text, absent parts left out."""
    parts = [title, F.array_join(path, " › "), overlap, text]
    return F.concat_ws("\n\n", *[F.when(F.length(p) > 0, p) for p in parts])
