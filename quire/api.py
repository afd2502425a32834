"""The five tools over a published index, their limits, and the configuration."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import chunker, fulltext, hybrid
from quire.operators.vectors import StubEmbedder, embed
from quire.plans import ingest as plans
from quire.plans.ingest import Snapshots


class ToolError(ValueError):
    """A request that is refused, with the reason as its text."""


@dataclass(frozen=True)
class Config:
    """Settings; invalid values are refused, not changed.  A flag beats the environment."""

    library: str
    index: str
    ingest_concurrency: int = 1
    max_file_mb: int = 512
    ocr: bool = True
    ocr_lang: str = "eng"
    ocr_workers: int = 1

    @classmethod
    def load(cls, argv: list[str], env: dict[str, str]) -> Config:
        given = {k: env[f"QUIRE_{k.upper()}"] for k in cls.__dataclass_fields__ if f"QUIRE_{k.upper()}" in env}
        for arg in argv:
            m = re.fullmatch(r"--([a-z-]+)=(.*)", arg)
            if not m or m.group(1).replace("-", "_") not in cls.__dataclass_fields__:
                raise ToolError(f"unknown option {arg}")
            given[m.group(1).replace("-", "_")] = m.group(2)
        if "library" not in given or "index" not in given:
            raise ToolError("library and index are required")
        values: dict = {}
        for k, v in given.items():
            if k in ("ingest_concurrency", "max_file_mb", "ocr_workers"):
                if not re.fullmatch(r"[1-9]\d*", v):
                    raise ToolError(f"{k} must be a positive whole number")
                values[k] = int(v)
            elif k == "ocr":
                if v not in ("on", "off"):
                    raise ToolError("ocr must be on or off")
                values[k] = v == "on"
            else:
                values[k] = v
        return cls(**values)


def redact(text: str, paths: dict[str, str]) -> str:
    """Replace known paths by names, the longest first."""
    for path in sorted(paths, key=len, reverse=True):
        text = text.replace(path, paths[path])
    return text


@dataclass
class Library:
    """Search, outline, context and delete over the current snapshot."""

    index: Snapshots
    embedder: object = field(default_factory=StubEmbedder)
    tables: dict[str, DataFrame] = field(init=False)

    def __post_init__(self) -> None:
        self.index.check(self.embedder.name, self.embedder.dim)
        self.refresh()

    def refresh(self) -> None:
        self.tables = self.index.read() or {}

    def search(self, query: str, k: int = 10, mode: str = "hybrid", filters: hybrid.Filters = hybrid.Filters()) -> DataFrame:
        """Ranked references without body text: rank, id, document_id, title, source_path, location, score, snippet."""
        if len(query.strip()) < 2:
            raise ToolError("a query has two characters or more")
        spark = self.index.spark
        q = spark.createDataFrame([(0, query, f"{self.embedder.query_prefix}{query}")], "question_id long, question string, asked string")
        q = q.join(embed(q, "question_id", "asked", self.embedder), "question_id")
        chunks, docs = self.tables["chunks"], self.tables["documents"]
        hits = hybrid.hybrid_search(chunks, docs, self.tables["vectors"].select("id", "embedding"), q, k, mode, filters, index=fulltext.Index(self.tables["postings"], stem=True))
        rows = hits.join(chunks, "id").join(docs.select("document_id", "title", "source_path"), "document_id").join(chunker.describe_location(chunks), "id")
        snippet = F.udf(lambda t: hybrid.semantic_snippet(t or "", query), "string")  # k rows at most
        return rows.select("rank", "id", "document_id", "title", "source_path", "kind", "seq", "location", "score", snippet("text").alias("snippet")).orderBy("rank")

    def processing(self) -> DataFrame:
        """Documents that are being indexed, so not yet searched: document_id, title, chunk_count, the oldest first."""
        return self.tables["documents"].filter("ingest_status = 'processing'").orderBy("updated_at", "document_id").select("document_id", "title", "chunk_count")

    def search_reply(self, query: str, **how) -> dict:
        """Hits, and what is being indexed and so may be missing among them."""
        hits = [r.asDict() for r in self.search(query, **how).collect()]
        return {"hits": hits, "processing_documents": [r.asDict() for r in self.processing().collect()]}

    def outline_reply(self, document_id: str, max_depth: int = 3) -> dict:
        """State of a document and its outline; one that is not ready has no entries yet."""
        entries = self.outline(document_id, max_depth)  # refuses what is unknown
        row = self.tables["documents"].filter(F.col("document_id") == document_id).first()
        state = {c: row[c] for c in ("document_id", "title", "format", "ingest_status", "chunk_count", "locator_count", "error_message", "ingest_warning")}
        return {**state, "entries": [r.asDict() for r in entries.collect()] if row.ingest_status == "ready" else []}

    def ingest(self, files: DataFrame, **how) -> DataFrame:
        """Index a batch of files (see ``plans.ingest.as_files``): source_path, outcome, document_id, title, format, status,
        locator_count, reused, warning, error.  A file in the way of another ingest is an error by itself."""
        done = plans.ingest(self.index, files, embedder=self.embedder, **how)
        self.refresh()
        docs = self.tables["documents"].select("sha256", "document_id", "title", "format", F.col("ingest_status").alias("status"), "locator_count", F.col("ingest_warning").alias("warning"), F.col("error_message").alias("error"))
        return done.join(docs, "sha256", "left").select("source_path", "outcome", "document_id", "title", "format", "status", "locator_count", (F.col("outcome") == "reused").alias("reused"), "warning", "error")

    def documents(self) -> DataFrame:
        return self.tables["documents"].orderBy(F.desc("created_at"), "document_id")

    def outline(self, document_id: str, max_depth: int = 3) -> DataFrame:
        if not 1 <= max_depth <= 6:
            raise ToolError("max_depth is 1 to 6")
        row = self.tables["documents"].filter(F.col("document_id") == document_id).first()
        if row is None:
            raise ToolError("unknown document")
        return chunker.outline(self.tables["chunks"].filter(F.col("document_id") == document_id), max_depth).orderBy("seq_start", "level")

    def context(self, id: int | None = None, document_id: str | None = None, seq: int | None = None, before: int = 1, after: int = 1) -> DataFrame:
        chunks = self.tables["chunks"]
        if id is not None:
            anchor = chunks.filter(F.col("id") == id)
        elif document_id is not None and seq is not None:
            anchor = chunks.filter((F.col("document_id") == document_id) & (F.col("seq") == seq))
        else:
            raise ToolError("give a chunk id, or a document id and seq")
        if anchor.isEmpty():
            raise ToolError("unknown chunk")
        return chunker.context(chunks, anchor, before, after).orderBy("seq")

    def delete(self, document_id: str) -> int:
        """Remove a document from every table; returns how many chunks went.  One being processed is refused."""
        row = self.tables["documents"].filter(F.col("document_id") == document_id).first()
        if row is None:
            raise ToolError("unknown document")
        if row.ingest_status == "processing":
            raise ToolError("the document is being processed")
        n = self.tables["chunks"].filter(F.col("document_id") == document_id).count()
        gone = self.index.spark.createDataFrame([(document_id,)], "document_id string")
        plans.delete(self.index, self.tables, gone)
        self.refresh()
        return n
