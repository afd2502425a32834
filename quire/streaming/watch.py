"""Streaming ingest: a folder is watched and every micro-batch is ingested; content hashes make it idempotent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.plans.ingest import Snapshots, ingest
from quire.sources.files import MAX_BYTES
from quire.sources.route import route

#: What the binary file source gives.
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(index: Snapshots, folder: str, checkpoint: str, once: bool = False, **how) -> StreamingQuery:
    """Route and ingest files as they appear; with ``once``, all that are there, then stop.  ``how`` goes to ``ingest``."""
    stream = index.spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.{md,markdown,txt,docx,pdf}").load(folder).filter(F.col("length") <= MAX_BYTES)
    name = F.element_at(F.split("path", "/"), -1)

    def batch(df: DataFrame, epoch: int) -> None:
        if not df.isEmpty():
            routed = route(df.select("path", "content"))
            ingest(index, routed.select(name.alias("source_path"), "format", "engine", "refusal", "content"), **how)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def lease_timeouts(events: DataFrame, minutes: int = 5) -> DataFrame:
    """Streaming view of claims: the last renewal of every document per window, late ones within the lease allowed."""
    marked = events.withWatermark("logged_at", f"{minutes} minutes")
    return marked.groupBy(F.window("logged_at", f"{minutes} minutes"), "document_id").agg(F.max("logged_at").alias("renewed_at"), F.count("*").alias("n"))
