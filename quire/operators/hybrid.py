"""Two ranked legs, weighted reciprocal rank fusion, filters at their places, escalation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators import fulltext, vectors
from quire.plans.storage import staged


@dataclass(frozen=True)
class Tuning:
    """Fusion parameters: a leg adds weight / (k + rank)."""

    k: float = 2.0
    lexical: float = 1.0
    semantic: float = 1.5


@dataclass(frozen=True)
class Filters:
    """What a search may be limited to."""

    document_id: str | None = None
    kind: str | None = None
    pages: tuple[int, int] | None = None
    section: str | None = None

    def __post_init__(self) -> None:
        if self.pages and (self.pages[0] < 1 or self.pages[0] > self.pages[1]):
            raise ValueError("page range must be 1 <= first <= last")


OVERFETCH, FILTERED_OVERFETCH, DOUBLINGS = 2, 32, 3


def section_matches(path: Column, prefix: Column) -> Column:
    """Whether a section trail begins with a prefix such as ``Part II › 3.2``; each part must end at a word's end."""
    clean = lambda c: F.lower(F.regexp_replace(c, "(?U)^\\s+|\\s+$", ""))
    wanted = F.filter(F.transform(F.split(prefix, "(?U)\\s*[›>]\\s*"), clean), lambda x: x != "")
    have = F.transform(F.slice(path, 1, F.greatest(F.size(wanted), F.lit(1))), lambda x: F.lower(x))
    begins = F.zip_with(wanted, have, lambda w, h: F.coalesce(h.startswith(w) & ~F.substr(h, F.length(w) + 1, F.lit(1)).rlike("[\\p{L}\\p{N}]"), F.lit(False)))
    return (F.size(wanted) == 0) | ((F.size(path) >= F.size(wanted)) & F.forall(begins, lambda x: x))


def fuse(ranked: DataFrame, tuning: Tuning = Tuning()) -> DataFrame:
    """(question_id, id, score) of ranks per leg (question_id, id, leg, rank from 1); a leg of weight 0 is left out."""
    weight = F.when(F.col("leg") == "lexical", F.lit(float(tuning.lexical))).when(F.col("leg") == "semantic", F.lit(float(tuning.semantic))).otherwise(0.0)
    part = ranked.withColumn("w", weight).filter("w > 0")
    return part.groupBy("question_id", "id").agg(F.sum(F.col("w") / (F.lit(float(tuning.k)) + F.col("rank"))).alias("score"))


def fused_top(ranked: DataFrame, k: int, tuning: Tuning = Tuning()) -> DataFrame:
    """The k best fused ids of each question; ties to the smaller id."""
    nth = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 12)), "id"))
    return fuse(ranked, tuning).withColumn("rank", nth).filter(F.col("rank") <= k)


def hybrid_search(chunks: DataFrame, documents: DataFrame, embeddings: DataFrame, queries: DataFrame, k: int = 10, mode: str = "hybrid", filters: Filters = Filters(), tuning: Tuning = Tuning(), stem: bool = True, ready_first: bool = False, index: fulltext.Index | None = None) -> DataFrame:
    """(question_id, rank, id, score, round): ranked hits of every query, one job for all queries.

    ``queries`` has question_id, question and, for the semantic leg, embedding; ``embeddings`` (id, embedding).  The
    lexical leg ranks after the ready, document, kind and page filters and before the section filter; the semantic
    leg ranks among all vectors of the document (all ready ones with ``ready_first``), other filters come after.
    Each leg fetches twice k, or 32 times k where filters follow it; while a query has fewer than k hits and such a
    leg was full, its limit doubles, three times at most.  A round searches only the queries that still need it.  ``index``
    is the full-text index of the chunks; without it that of ``fulltext.index_of`` is taken.
    """
    if not 1 <= k <= 50:
        raise ValueError("k must be 1 to 50")
    if mode not in ("hybrid", "lexical", "semantic"):
        raise ValueError("unknown mode")
    f = filters
    ready = documents.filter("ingest_status = 'ready'").select("document_id")
    meta = chunks.select("id", "document_id", "kind", "page_number", "section_path").join(ready, "document_id", "left_semi")
    pushed = meta
    if f.document_id is not None:
        pushed = pushed.filter(F.col("document_id") == f.document_id)
    if f.kind is not None:
        pushed = pushed.filter(F.col("kind") == f.kind)
    if f.pages is not None:
        pushed = pushed.filter(F.col("page_number").between(*f.pages))
    allowed = pushed.filter(section_matches(F.col("section_path"), F.lit(f.section))) if f.section else pushed
    post = {"lexical": bool(f.section), "semantic": bool(f.kind or f.pages or f.section)}
    limit = {leg: k * (FILTERED_OVERFETCH if post[leg] else OVERFETCH) for leg in post}
    index = index or (fulltext.index_of(chunks.select("id", "text"), stem) if mode != "semantic" else None)
    pool = embeddings
    if f.document_id is not None:
        pool = pool.join(chunks.filter(F.col("document_id") == f.document_id).select("id"), "id", "left_semi")
    if ready_first:
        pool = pool.join(meta.select("id"), "id", "left_semi")
    sample = 0 if f.document_id is not None or ready_first else 16
    if mode != "hybrid":
        tuning = Tuning(tuning.k, float(mode == "lexical"), float(mode == "semantic"))
    lexical, left, rounds = None, queries, []
    for r in range(DOUBLINGS + 1):
        most = {leg: limit[leg] * (1 << r if post[leg] else 1) for leg in post}
        legs = []
        if mode != "semantic":
            if lexical is None or post["lexical"]:
                lexical = staged(fulltext.bm25(index, left, pushed.select("id"), most["lexical"]).select("question_id", "id", F.lit("lexical").alias("leg"), "rank"), "lexical")
            legs.append(lexical if r == 0 else lexical.join(left.select("question_id"), "question_id", "left_semi"))
        if mode != "lexical":
            sem = vectors.knn(left, pool, most["semantic"], sample=sample)
            legs.append(sem.select("question_id", "id", F.lit("semantic").alias("leg"), "rank"))
        ranked = staged(legs[0] if len(legs) == 1 else legs[0].unionByName(legs[1]), "legs")
        limits = F.when(F.col("leg") == "lexical", most["lexical"]).otherwise(most["semantic"])
        eligible = F.when(F.col("leg") == "lexical", F.lit(post["lexical"])).otherwise(F.lit(post["semantic"]))
        full = ranked.groupBy("question_id", "leg").agg(F.count("*").alias("n")).withColumn("full", eligible & (F.col("n") == limits)).groupBy("question_id").agg(F.max("full").alias("full"))
        hits = fuse(ranked, tuning).join(allowed.select("id"), "id", "left_semi")
        nth = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 12)), "id"))
        hits = hits.withColumn("rank", nth).filter(F.col("rank") <= k).select("question_id", "rank", "id", "score", F.lit(r).alias("round"))
        if r == DOUBLINGS or not any(post[x] for x in legs_of(mode)):
            rounds.append(hits)
            break
        hits = staged(hits, "hits")
        n = hits.groupBy("question_id").agg(F.count("*").alias("hits"))
        more = staged(full.join(n, "question_id", "left").filter((F.coalesce("hits", F.lit(0)) < k) & F.col("full")).select("question_id"), "more")
        if more.isEmpty():
            rounds.append(hits)
            break
        rounds.append(hits.join(more, "question_id", "left_anti"))
        left = queries.join(more, "question_id", "left_semi")
    return reduce(DataFrame.unionByName, rounds)


def legs_of(mode: str) -> tuple[str, ...]:
    return ("lexical", "semantic") if mode == "hybrid" else (mode,)


def semantic_snippet(text: str, query: str, most: int = 300) -> str:
    """The whole text if short; else a window of ``most`` UTF-16 units whose middle is that of the sentence which shares
    most words with the query (the first of equals), cut at the ends of the text; the text's head if none shares any."""
    import re

    from quire.functions.pieces import utf16_len

    raw = text.encode("utf-16-le", "surrogatepass")
    size = len(raw) // 2
    if size <= most:
        return text

    def units(a: int, b: int) -> str:
        return raw[2 * a : 2 * b].decode("utf-16-le", "replace")

    words = re.compile(r"[^\W_]{3,}")
    wanted = set(words.findall(query.lower()))
    scored = [(sum(w in wanted for w in words.findall(m.group().lower())), -m.start(), m.end()) for m in re.finditer(r"[^.!?]+[.!?]*", text)]
    hits, first, last = max(scored, default=(0, 0, 0))
    if not hits:
        return units(0, most).rstrip() + "…"
    middle = utf16_len(text[:-first]) + utf16_len(text[-first:last]) / 2
    start = max(0, int(middle - most / 2))
    end = min(size, start + most)
    return ("…" if start else "") + units(start, end).strip() + ("…" if end < size else "")
