"""Send the package to the executors, whose Python may start anywhere."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

from quire.plans.storage import shared_folder

_SENT: set[str] = set()


def archive() -> bytes:
    """The package's source as a zip archive."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, through the shared folder, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/quire/code-{sc.applicationId}/quire.zip")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    stream = fs.create(path, True)
    stream.write(bytearray(archive()))
    stream.close()
    sc.addPyFile(fs.makeQualified(path).toString())
    _SENT.add(sc.applicationId)
