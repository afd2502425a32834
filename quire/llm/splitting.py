"""Problem 7: cut oversized items at natural boundaries, by balanced targets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import estimate_tokens

#: Strength of a cut after the match of each pattern, strongest first; any other place between characters has 0.
BOUNDARIES = ((5, re.compile(r"\n[^\S\n]*\n\s*")), (4, re.compile(r"\n+")), (3, re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？]")), (2, re.compile(r"[,;:–—]\s+|[、；：]")), (1, re.compile(r"\s+")))
_CJK = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF))


def quarters(text: str) -> np.ndarray:
    """Running size in quarter tokens: 4 for a cjk character, 2 beyond the basic plane, else 1."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.where(code >= 0x10000, 2, 1)
    for lo, hi in _CJK:
        size[(code >= lo) & (code <= hi)] = 4
    return np.concatenate([[0], np.cumsum(size)])


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each code point (and at the end)."""
    out = np.zeros(len(text) + 1, dtype=np.int8)
    for strength, pattern in reversed(BOUNDARIES):
        for m in pattern.finditer(text):
            out[m.end()] = max(out[m.end()], strength)
    return out


def cut(text: str, max_tokens: int, overlap_tokens: int) -> list[tuple[int, int, int]]:
    """(start, body, end) of each piece in code points: the piece is text[start:end], of which text[start:body]
    repeats the end of the piece before.  Bodies join to the text; every piece is within ``max_tokens``, the
    repeated part within ``overlap_tokens``, of which no more than half of ``max_tokens`` counts (shortened to begin at
    a word where it can)."""
    w, force = quarters(text), strengths(text)
    limit, lap = 4 * max_tokens, min(4 * overlap_tokens, 2 * max_tokens)
    total, n_chars = int(w[-1]), len(text)
    if total <= limit:
        return [(0, 0, n_chars)]
    if limit < 4:
        raise ValueError("a single character can exceed the limit")
    n = max(2, -(-(total - lap) // (limit - lap)))
    while True:
        pieces, body, start, ok = [], 0, 0, True
        for k in range(1, n + 1):
            last = int(np.searchsorted(w, w[start] + limit, side="right")) - 1  # the furthest end within the limit
            if k == n:
                ok = last >= n_chars
                end = n_chars
            else:
                target = total * k / n
                slack = total / n * 0.25
                lo = max(body + 1, int(np.searchsorted(w, target - slack)))
                hi = min(last, int(np.searchsorted(w, target + slack, side="right")) - 1)
                if hi < lo:
                    lo, hi = body + 1, min(last, max(body + 1, int(np.searchsorted(w, target))))
                if hi < lo:
                    ok = False
                    break
                window = force[lo : hi + 1]
                best = np.flatnonzero(window == window.max()) + lo
                end = int(best[np.abs(w[best] - target).argmin()])
            if not ok:
                break
            pieces.append((start, body, end))
            body = end
            start = end
            if lap:
                first = int(np.searchsorted(w, w[end] - lap))
                words = np.flatnonzero(force[first:end] > 0)
                start = first + int(words[0]) if len(words) else first
        if ok:
            return pieces
        n += 1
        if n > total:
            raise ValueError("a single character exceeds the limit")


_SCHEMA = "id long, kind string, piece int, n_pieces int, start int, body int, end int, text string"


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            pieces = cut(r["text"], r["max_tokens"], r["overlap_tokens"] or 0)
            rows += [(r["id"], r["kind"], k, len(pieces), s, b, e, r["text"][s:e]) for k, (s, b, e) in enumerate(pieces)]
        cols = list(zip(*rows)) or [[]] * 8
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["id", "kind", "piece", "n_pieces", "start", "body", "end", "text"])


def split_oversized(chunks: DataFrame, limits: DataFrame, max_limits: int = 1000) -> DataFrame:
    """Cut each chunk whose text exceeds its kind's limit in unit ``estimate``.

    The least piece count that can hold the text gives equal-length targets; each is snapped to the strongest
    boundary nearby (paragraph, line, sentence, clause, word, any character), and a piece is added whenever a
    limit fails.  The stored token_count is not read.  Chunks within their limit, with null text or of a kind
    without limit are not returned.  Of repeated limit rows the smallest holds.  ``limits`` is a parameter table
    of at most ``max_limits`` rows, else an error is raised.

    Result: id, kind, piece, n_pieces, start, body, end (code points), text, tokens.
    """
    wanted = limits.filter((F.col("unit") == "estimate") & (F.col("max_tokens") > 0)).groupBy(F.col("item").alias("kind")).agg(F.min(F.struct("max_tokens", "overlap_tokens")).alias("l"))
    rows = wanted.limit(max_limits + 1).collect()
    if len(rows) > max_limits:
        raise ValueError("too many limits for a parameter table")
    spark = chunks.sparkSession
    small = spark.createDataFrame([(r.kind, r.l.max_tokens, r.l.overlap_tokens) for r in rows], "kind string, max_tokens int, overlap_tokens int")
    base = chunks.filter(F.col("text").isNotNull()).select(F.col("id").cast("long").alias("id"), "kind", "text")
    over = base.join(F.broadcast(small), "kind").filter((F.length("text") > F.col("max_tokens")) & (estimate_tokens(F.col("text")) > F.col("max_tokens")))
    pieces = over.select("id", "kind", "text", "max_tokens", "overlap_tokens").mapInArrow(_cut_rows, _SCHEMA)
    return pieces.withColumn("tokens", estimate_tokens(F.col("text")))
