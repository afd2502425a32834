"""Ingest: claims as one set-based decision, files to chunks in one pass, segments with a pointer, deletes, leases."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import fulltext
from quire.operators.chunker import Block, chunk_blocks
from quire.operators.vectors import StubEmbedder, embed, embed_input
from quire.plans.storage import file_system, staged
from quire.sources import markup, pdf
from quire.sources.files import decode
from quire.sources.pdf_bytes import read_pdf
from quire.sources.route import chosen_title, route


LEASE_MINUTES = 5
SCHEMA_VERSION = 5
MODEL, DIM = StubEmbedder.name, StubEmbedder.dim


class IndexMismatch(RuntimeError):
    """The index was written by another schema or embedding model."""


def lease_live(updated_at: Column, now: Column) -> Column:
    """Whether a claim was renewed less than five minutes ago; a missing or unreadable time is no claim."""
    return F.coalesce(F.try_to_timestamp(updated_at.cast("string")) > now - F.expr(f"INTERVAL {LEASE_MINUTES} MINUTES"), F.lit(False))


def claims(incoming: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """(sha256, source_path, outcome, supersede) of incoming files (sha256, source_path).

    A live claim on the same content joins it; else another live claim at the path (compared without ASCII case) is
    an error; ready content is reused; all else starts.  ``supersede`` lists the other documents at the path: for
    reused content they go at once, for started content when it is ready.  Of repeated contents the row last updated
    counts.
    """
    live = (F.col("ingest_status") == "processing") & lease_live(F.col("updated_at"), now)
    docs = documents.filter("sha256 is not null").withColumn("live", live)
    of_sha = docs.groupBy(F.lower("sha256").alias("key")).agg(F.max(F.struct("updated_at", "document_id", "ingest_status", "live")).alias("own"))
    files = incoming.select("sha256", "source_path", F.lower("sha256").alias("key"), F.lower("source_path").alias("at")).distinct()
    others = files.select("key", "at").distinct().join(docs.select(F.lower("source_path").alias("at"), F.lower("sha256").alias("other"), "document_id", "live"), "at").filter("key <> other")
    stale = others.groupBy("key", "at").agg(F.max("live").alias("blocked"), F.sort_array(F.collect_set("document_id")).alias("stale"))
    rows = files.join(of_sha, "key", "left").join(stale, ["key", "at"], "left")
    outcome = F.when(F.coalesce(F.col("own.live"), F.lit(False)), "joined").when(F.coalesce("blocked", F.lit(False)), "error").when(F.col("own.ingest_status") == "ready", "reused").otherwise("started")
    none = F.array().cast("array<string>")
    return rows.select("sha256", "source_path", outcome.alias("outcome"), F.coalesce("stale", none).alias("stale")).select("sha256", "source_path", "outcome", F.when(F.col("outcome").isin("reused", "started"), F.col("stale")).otherwise(none).alias("supersede"))


def recover_interrupted(documents: DataFrame, now: Column) -> DataFrame:
    """Documents with expired claims become failed."""
    dead = (F.col("ingest_status") == "processing") & ~lease_live(F.col("updated_at"), now)
    return documents.withColumn("error_message", F.when(dead, "interrupted").otherwise(F.col("error_message"))).withColumn("ingest_status", F.when(dead, "failed").otherwise(F.col("ingest_status")))


def renew(documents: DataFrame, document_id: str, now: Column) -> DataFrame:
    """Renew a claim; only a processing document has one."""
    mine = (F.col("document_id") == document_id) & (F.col("ingest_status") == "processing")
    return documents.withColumn("updated_at", F.when(mine, now).otherwise(F.col("updated_at")))


#: Tables that grow by segments; documents are one table.
GROWING = ("chunks", "vectors", "postings")


class Snapshots:
    """An index of immutable segments and a numbered pointer that names those in force.

    A batch of files is one more segment (chunks, vectors, postings); what goes is listed (chunk id, last segment it is
    gone from), so neither ingest nor delete rewrites what is there; ``compact`` does.  Readers resolve the newest
    pointer once.  A pointer is created, never replaced, so of two writers one fails, and a failed write leaves the old
    state in force.  All files are reached by Spark's own file systems.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        fs, path = file_system(spark, f"{self.root}/pointers")
        fs.mkdirs(path)

    def _pointer(self) -> tuple[int, str] | None:
        fs, path = file_system(self.spark, f"{self.root}/pointers")
        names = sorted(str(x.getPath().getName()) for x in fs.listStatus(path))
        names = [n for n in names if n.endswith(".json") and not n.startswith(".")]
        return (int(names[-1][:-5]), f"{self.root}/pointers/{names[-1]}") if names else None

    def meta(self) -> dict | None:
        at = self._pointer()
        return json.loads("\n".join(r.value for r in self.spark.read.text(at[1]).collect())) if at else None

    def check(self, model: str = MODEL, dim: int = DIM) -> None:
        """Refuse an index of another schema, model or number of dimensions, or one with documents of several models."""
        meta = self.meta()
        if not meta:
            return
        if (meta["schema"], meta["model"], meta["dim"]) != (SCHEMA_VERSION, model, dim):
            raise IndexMismatch(f"index has schema {meta['schema']}, model {meta['model']}, {meta['dim']} dimensions")
        held = [r[0] for r in self.spark.read.parquet(meta["documents"]).select("embedding_model").filter("embedding_model is not null").distinct().limit(3).collect()]
        if set(held) - {model}:
            raise IndexMismatch(f"index has documents of {', '.join(sorted(held))}")

    def read(self) -> dict[str, DataFrame] | None:
        meta = self.meta()
        if not meta:
            return None
        out = {"documents": self.spark.read.parquet(meta["documents"])}
        gone = self.spark.read.parquet(meta["gone"]).select(F.col("id").alias("gone_id"), "upto") if meta["gone"] else None
        for t in GROWING:
            df = self.spark.read.parquet(*[f"{self.root}/segments/{s}/{t}" for s in meta["segments"]])
            if gone is not None:
                df = df.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("segment") <= F.col("upto")), "left_anti")
            out[t] = df.drop("segment")
        return out

    def _point(self, state: dict) -> None:
        at = self._pointer()
        fs, path = file_system(self.spark, f"{self.root}/pointers/{(at[0] if at else 0) + 1:012d}.json")
        stream = fs.create(path, False)  # fails if another writer was first
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()

    def publish(self, documents: DataFrame, new: dict[str, DataFrame] | None = None, gone: DataFrame | None = None, model: str = MODEL, dim: int = DIM) -> None:
        """Put ``documents`` in force with one more segment of ``new`` tables, without the chunks (id) in ``gone``."""
        meta = self.meta() or {"segments": [], "gone": None, "last": 0}
        state = {"schema": SCHEMA_VERSION, "model": model, "dim": dim, "segments": list(meta["segments"]), "gone": meta["gone"], "last": meta["last"], "documents": f"{self.root}/documents/{uuid.uuid4().hex}"}
        documents.write.parquet(state["documents"])
        if gone is not None:
            listed = gone.select(F.col("id").cast("long").alias("id"), F.lit(meta["last"]).alias("upto"))
            if meta["gone"]:
                listed = listed.unionByName(self.spark.read.parquet(meta["gone"]))
            state["gone"] = f"{self.root}/gone/{uuid.uuid4().hex}"
            listed.groupBy("id").agg(F.max("upto").alias("upto")).write.parquet(state["gone"])
        if new is not None:
            state["last"] += 1
            name = f"{state['last']:08d}-{uuid.uuid4().hex[:8]}"
            for t in GROWING:
                new[t].withColumn("segment", F.lit(state["last"])).write.parquet(f"{self.root}/segments/{name}/{t}")
            state["segments"].append(name)
        self._point(state)

    def compact(self) -> None:
        """Write all that is in force as one segment."""
        meta, tables = self.meta(), self.read()
        if not meta or not tables:
            return
        last = meta["last"] + 1
        name = f"{last:08d}-{uuid.uuid4().hex[:8]}"
        for t in GROWING:
            df = tables[t].withColumn("segment", F.lit(last))
            (df.sortWithinPartitions("term", "id") if t == "postings" else df).write.parquet(f"{self.root}/segments/{name}/{t}")
        self._point({**meta, "segments": [name], "gone": None, "last": last})

    def counts(self) -> dict[str, int]:
        """Documents, and records of each index; chunks, postings and vectors must agree."""
        tables = self.read() or {}
        return {t: (df.filter("term is null") if t == "postings" else df).count() for t, df in tables.items()}


def without_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the given document_id values."""
    gone = ids.select("document_id").distinct()
    return {t: df.join(gone, "document_id", "left_anti") for t, df in tables.items()}


def chunks_of_documents(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """(id) of the chunks of the given document_id values."""
    return chunks.join(ids.select("document_id").distinct(), "document_id", "left_semi").select("id")


_PARSED = "sha256 string, parsed_title string, scheme string, expected int, problem string, seq int, kind string, locator string, ordinal int, section_path array<string>, bbox array<double>, text string, overlap string, tokens int"


def parse_file(format: str, path: str, content: bytes, parse: Callable[[str, str, str], Iterable[Block]] = markup.parse_text, pdf_reader: Callable[[bytes], dict] | None = None) -> tuple[str | None, str, int, list[Block]]:
    """(title, locator scheme, expected locators, blocks) of one file.

    ``pdf_reader`` (``read_pdf`` if there is none) gives what a reader of PDF knows: pages of text runs, and if it has
    them title, width, height, bookmarks, which pages paint images, and for scanned files recognised pages (see
    ``pdf.scanned_blocks``).  A text layer that is of no use is refused where no pages are recognised."""
    name = path.rsplit("/", 1)[-1]
    if format == "docx":
        blocks = list(markup.docx_blocks(content))
        title, expected = markup.docx_metadata(content, "", blocks)
        return title or None, "section", expected, blocks
    if format == "pdf":
        got = (pdf_reader or read_pdf)(content)
        title = pdf.usable_title(got.get("title"))
        if "recognised" in got:
            return title, "page", len(got["recognised"]), list(pdf.scanned_blocks(got["recognised"], got.get("force", False)))
        poor = pdf.poor_text_layer(got["pages"], got.get("images"))
        if poor:
            raise ValueError(f"{poor}, and no pages are recognised")
        return title, "page", len(got["pages"]), list(pdf.pdf_blocks(got["pages"], got.get("width", 612), got.get("height", 792), got.get("bookmarks", ())))
    text = decode(content)
    title, expected = (markup.markdown_metadata if format == "md" else markup.text_metadata)(text, "")
    return title or None, "section", expected, list(parse(format, name, text))


def _chunked(parse: Callable, pdf_reader: Callable | None) -> Callable:
    """Chunks of every file in one pass; one row without seq for a file that gives none, with the reason."""
    names = [c.split(" ")[0] for c in _PARSED.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.string(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for f in batch.to_pylist():
                none = (None,) * 9
                if f["refusal"]:
                    rows.append((f["sha256"], None, "section", 0, f["refusal"], *none))
                    continue
                try:
                    title, scheme, expected, blocks = parse_file(f["format"], f["source_path"] or "", f["content"] or b"", parse, pdf_reader)
                except Exception as e:  # noqa: BLE001  (a file that cannot be read fails by itself)
                    rows.append((f["sha256"], None, "section", 0, f"unreadable: {str(e)[:200]}", *none))
                    continue
                got = list(chunk_blocks(blocks))
                head = (f["sha256"], title, scheme, expected)
                rows += [(*head, None, n, c.kind, c.locator, c.ordinal, c.path, c.bbox, c.text, c.overlap, c.tokens) for n, c in enumerate(got)] or [(*head, "no text", *none)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return run


def as_files(files: DataFrame) -> DataFrame:
    """(source_path, format, engine, refusal, title, content) of files given with content, or with text."""
    have = set(files.columns)
    null = F.lit(None).cast("string")
    content = F.col("content") if "content" in have else F.encode("text", "UTF-8")
    cols = [F.col(c) if c in have else d.alias(c) for c, d in (("format", F.lit("txt")), ("engine", F.lit("ts-fast")), ("refusal", null), ("title", null))]
    return files.select("source_path", *cols, content.alias("content"))


def build(files: DataFrame, parse: Callable[[str, str, str], Iterable] = markup.parse_text, embedder: object | None = None, pdf_reader: Callable | None = None) -> dict[str, DataFrame]:
    """Documents, chunks, vectors and postings of files (see ``as_files``).

    Identity is the content's hash; equal contents are indexed once, under the smallest path.  A title that was given
    beats the file's own, and that its name.  A refused or unreadable file, and one without text, fails with the reason.
    """
    maker = embedder or StubEmbedder()
    keyed = as_files(files).withColumn("sha256", F.sha2("content", 256))
    one = keyed.groupBy("sha256").agg(F.min(F.struct("source_path", "format", "engine", "refusal", "title", "content")).alias("f")).select("sha256", "f.*")
    one = staged(one.withColumn("document_id", F.substring("sha256", 1, 26)), "files")
    parsed = staged(one.select("sha256", "source_path", "format", "refusal", "content").mapInArrow(_chunked(parse, pdf_reader), _PARSED), "parsed")
    facts = parsed.groupBy("sha256").agg(F.max("parsed_title").alias("parsed_title"), F.max("scheme").alias("locator_scheme"), F.max("expected").alias("expected"), F.max("problem").alias("error_message"), F.count("seq").cast("int").alias("chunk_count"), F.countDistinct("locator").cast("int").alias("locators"))
    name = F.regexp_replace(F.element_at(F.split("source_path", "/"), -1), "\\.[^.]*$", "")
    documents = one.drop("content").join(facts, "sha256")
    documents = documents.withColumn("title", chosen_title(F.col("title"), F.col("parsed_title"), name))
    cut = parsed.filter("seq is not null").join(documents.select("sha256", "document_id", "title"), "sha256").withColumn("id", F.xxhash64("sha256", "seq"))
    page = F.col("scheme") == "page"
    chunks = cut.select("id", "document_id", "seq", "kind", F.col("scheme").alias("locator_type"), F.col("locator").alias("locator_value"), F.col("ordinal").alias("locator_ordinal"), F.when(page, F.col("ordinal") + 1).alias("page_number"), F.lit(None).cast("string").alias("printed_label"), "section_path", "bbox", "text", F.col("tokens").alias("token_count"))
    passages = cut.select("id", embed_input(F.col("title"), F.col("section_path"), F.col("overlap"), F.col("text")).alias("passage"))
    vectors = embed(passages, "id", "passage", maker)
    postings = fulltext.inverted(cut.select("id", "text"), stem=True).sortWithinPartitions("term", "id")
    failed = F.col("chunk_count") == 0
    documents = documents.select("document_id", "title", "source_path", "format", "sha256", F.col("engine").alias("engine_used"), "locator_scheme", F.greatest("expected", "locators").alias("locator_count"), "chunk_count", F.when(~failed, F.lit(maker.name)).alias("embedding_model"), F.when(failed, "failed").otherwise("ready").alias("ingest_status"), F.when(failed, F.coalesce("error_message", F.lit("no text"))).alias("error_message"), F.lit(None).cast("string").alias("ingest_warning"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))
    return {"documents": documents, "chunks": chunks, "vectors": vectors, "postings": postings}


def ingest(index: Snapshots, files: DataFrame, parse: Callable[[str, str, str], Iterable] = markup.parse_text, now: datetime | None = None, embedder: object | None = None, pdf_reader: Callable | None = None) -> DataFrame:
    """Index a batch of files (see ``as_files``); publishes one segment; returns the claims (sha256, source_path, outcome,
    supersede).

    What superseded documents held stays searchable until their successors are published with them gone; a document
    that fails supersedes nothing.
    """
    maker = embedder or StubEmbedder()
    index.check(maker.name, maker.dim)
    old = index.read()
    at = F.lit(now) if now else F.current_timestamp()
    incoming = staged(as_files(files).select(F.sha2("content", 256).alias("sha256"), "source_path").distinct(), "incoming")
    if old is None:
        new = build(files, parse, maker, pdf_reader)
        index.publish(staged(new["documents"], "documents"), new, None, maker.name, maker.dim)
        return incoming.select("sha256", "source_path", F.lit("started").alias("outcome"), F.array().cast("array<string>").alias("supersede"))
    done = staged(claims(incoming, old["documents"], at), "claims")
    started = done.filter("outcome = 'started'").select("sha256").distinct()
    # what is reused or joined is neither parsed nor embedded again
    fresh = as_files(files).join(started.withColumnRenamed("sha256", "fresh"), F.sha2("content", 256) == F.col("fresh"), "left_semi")
    new = build(fresh, parse, maker, pdf_reader)
    fresh_docs = staged(new["documents"], "documents")
    ready = fresh_docs.filter("ingest_status = 'ready'").select("sha256")
    gone = done.join(ready.withColumn("ok", F.lit(True)), "sha256", "left").filter("outcome = 'reused' or ok").select(F.explode("supersede").alias("document_id"))
    gone = staged(gone.union(fresh_docs.select("document_id")).distinct(), "superseded")
    moved = done.filter("outcome = 'reused'").groupBy("sha256").agg(F.min("source_path").alias("to"))
    kept = old["documents"].join(gone, "document_id", "left_anti")
    documents = kept.join(moved, "sha256", "left").withColumn("source_path", F.coalesce("to", "source_path")).drop("to").select(*old["documents"].columns)
    index.publish(documents.unionByName(fresh_docs), new if not ready.isEmpty() else None, chunks_of_documents(old["chunks"], gone), maker.name, maker.dim)
    return done


def delete(index: Snapshots, tables: dict[str, DataFrame], ids: DataFrame) -> None:
    """Take the given document_id values out of force."""
    index.publish(tables["documents"].join(ids.select("document_id").distinct(), "document_id", "left_anti"), None, chunks_of_documents(tables["chunks"], ids))


def ingest_folder(index: Snapshots, root: str, recursive: bool = False, max_bytes: int | None = None, ocr: bool = True, probes: DataFrame | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """Walk a library folder, route every file by its content and ingest what is found.

    Returns (claims, totals): totals has one row, indexed, skipped, failed.  Files beyond the size limit fail unread.
    """
    from quire.sources.files import MAX_BYTES, library

    found, refused = library(index.spark, root, recursive, max_bytes or MAX_BYTES)
    base = root.rstrip("/") + "/"
    relative = F.expr("substring(path, locate(?, path) + length(?))".replace("?", "'" + base.replace("'", "\\'") + "'"))
    routed = route(found.select("path", "content"), ocr, probes).withColumn("source_path", relative)
    done = ingest(index, routed.select("source_path", "format", "engine", "refusal", "content"), **how)
    state = (index.read() or {})["documents"].select("sha256", F.col("ingest_status").alias("state"))
    seen = done.join(state, "sha256", "left")
    totals = seen.agg(F.count_if((F.col("outcome") == "started") & (F.col("state") == "ready")).alias("indexed"), F.count_if(F.col("outcome").isin("reused", "joined")).alias("skipped"), F.count_if((F.col("outcome") == "error") | ((F.col("outcome") == "started") & (F.coalesce("state", F.lit("")) != "ready"))).alias("failed"))
    large = refused.agg(F.count("*").alias("large"))
    return done, totals.crossJoin(large).select("indexed", "skipped", (F.col("failed") + F.col("large")).alias("failed"))
