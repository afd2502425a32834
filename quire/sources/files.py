"""Reading a library of files, zip archives with limits, and the corpus manifest."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.paths import WALKED

MAX_BYTES = 512_000_000
ENTRY_BYTES, ARCHIVE_BYTES = 20_000_000, 80_000_000


class ArchiveTooLarge(ValueError):
    """A zip archive inflates beyond its limits."""


def library(spark: SparkSession, root: str, recursive: bool = False, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, refused): path, length, content of the walked files of a folder, and path, length of those too large.

    Names that begin with a dot are skipped, so are other extensions.  The size limit is pushed to the scan, so a
    refused file is never read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(root).withColumn("relative", F.expr("substring(path, locate(?, path) + length(?) + 1)".replace("?", f"'{root.rstrip('/')}'")))
    named = F.lower(F.regexp_extract("path", "(\\.[^./]*)$", 1)).isin(*WALKED) & ~F.col("relative").rlike("(^|/)\\.")
    found = found.filter(named)
    return found.filter(F.col("length") <= max_bytes).select("path", "length", "content"), found.filter(F.col("length") > max_bytes).select("path", "length")


def decode(content: bytes) -> str:
    """UTF-8 without byte order mark; malformed bytes become replacement characters."""
    return bytes(content).decode("utf-8-sig", "replace")


def open_zip(content: bytes, keep: Callable[[str, int], bool] = lambda name, size: True, entry: int = ENTRY_BYTES, archive: int = ARCHIVE_BYTES) -> dict[str, bytes]:
    """Entries of a zip archive; asks ``keep`` before it inflates; the first of repeated names counts."""
    out: dict[str, bytes] = {}
    total = 0
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        for info in z.infolist():
            if info.filename in out or info.is_dir() or not keep(info.filename, info.file_size):
                continue
            with z.open(info) as f:
                data = f.read(entry + 1)
            total += len(data)
            if len(data) > entry or total > archive:
                raise ArchiveTooLarge(info.filename)
            out[info.filename] = data
    return out


def verify_manifest(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """(file, state): OK, MISSING, ALTERED or UNLISTED, of manifest (file, sha256) against listing (file, sha256)."""
    m = manifest.select("file", F.lower("sha256").alias("want"), F.lit(True).alias("listed"))
    have = listing.select("file", F.lower("sha256").alias("got"), F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "MISSING").when(F.col("listed").isNull(), "UNLISTED").when(F.col("want").eqNullSafe(F.col("got")), "OK").otherwise("ALTERED")
    return m.join(have, "file", "full_outer").select("file", state.alias("state"))
