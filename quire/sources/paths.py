"""Library paths: what may be read, and how it is named."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that may be addressed, and those a directory walk takes.
ADDRESSABLE = (".pdf", ".docx", ".doc", ".md", ".markdown", ".html", ".htm", ".txt")
WALKED = (".md", ".markdown", ".txt", ".pdf", ".docx")


class PathRefused(ValueError):
    """The path may not be read."""


def resolve(root: str, relative: str) -> str:
    """Absolute path of a library file; refuses empty and NUL paths, the root, what lies outside, other extensions."""
    if not relative or not relative.strip() or "\0" in relative:
        raise PathRefused("empty or malformed path")
    base = os.path.abspath(root)
    full = os.path.normpath(os.path.join(base, relative))
    inside = os.path.relpath(full, base)
    if inside == "." or inside == ".." or inside.startswith(".." + os.sep) or os.path.isabs(inside):
        raise PathRefused("path leaves the library")
    if os.path.splitext(full)[1].lower() not in ADDRESSABLE:
        raise PathRefused("extension is not allowed")
    return full


def real_inside(root: str, full: str) -> str:
    """The path after links are followed, which must still be inside; a missing file keeps its lexical path."""
    if not os.path.exists(full):
        return full
    real, base = os.path.realpath(full), os.path.realpath(root)
    if os.path.commonpath([real, base]) != base or real == base:
        raise PathRefused("link leaves the library")
    return real


def library_relative(root: str, full: str) -> str:
    return os.path.relpath(full, os.path.abspath(root)).replace(os.sep, "/")


def addressable(path: Column) -> Column:
    """The lexical rules of ``resolve`` over a column of relative paths."""
    ext = F.lower(F.regexp_extract(path, "(\\.[^./]*)$", 1))
    clean = path.isNotNull() & (F.trim(path) != "") & ~path.contains("\0") & ~path.startswith("/")
    depth = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda a, s: F.struct((a["d"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(s == "..", -1).otherwise(0)).alias("low")),
    )
    return clean & ext.isin(*ADDRESSABLE) & (depth["low"] >= 0) & (depth["d"] > 0)
