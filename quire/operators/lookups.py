"""Point lookups, existence, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_sha256(documents: DataFrame, sha256: str) -> DataFrame:
    return documents.filter(F.lower("sha256") == sha256.lower())


def by_chunk_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("chunk_id") == chunk_id)


def by_seq(chunks: DataFrame, document_id: str, seq: int) -> DataFrame:
    return chunks.filter((F.col("document_id") == document_id) & (F.col("seq") == seq))


def chunk_exists(chunks: DataFrame, document_id: str, seq: int) -> bool:
    return not by_seq(chunks, document_id, seq).isEmpty()


def references(chunks: DataFrame) -> DataFrame:
    """What a search may show of chunks: where they are and of what kind, not their text."""
    return chunks.select("chunk_id", "document_id", "seq", "kind", "locator_type", "locator_value", "page_number", "printed_label", "section_path", "token_count")


def hydrate(ids: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of ready documents for a set of ids, with title and source path; texts are read for these only."""
    ready = documents.filter("ingest_status = 'ready'").select("document_id", F.col("title").alias("document_title"), "source_path")
    return chunks.join(ids.select("id").distinct(), "id", "left_semi").join(ready, "document_id")


def random_sample(rows: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """``n`` rows in a random order that the seed fixes."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
