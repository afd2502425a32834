"""Which format a file is, which engine reads it, whether a text layer is fit for use, and its title."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Refusals by recognised format.
REFUSALS = {"html": "HTML is not supported", "epub": "EPUB is not supported", "pptx": "PowerPoint is not supported", "ole": "old binary Office files are not supported", "binary": "the file is binary"}
# Parts that give a title no meaning, as patterns: products, generic words (a number may follow), fillers.
PRODUCTS = ("(microsoft\\s+)?(powerpoint|word|excel|impress|keynote)",)
GENERIC = (
    "presentations?", "présentations?", "presentaci[óo]n", "apresenta[çc][ãa]o", "presentazione", "pr[äa]sentation", "prezentacja", "presentatie",
    "slides?", "deck", "documento?s?", "dokumente?", "untitled", "no\\s+title", "sin\\s+t[íi]tulo", "sem\\s+t[íi]tulo", "ohne\\s+titel", "sans\\s+titre",
)
FILLERS = ("de", "del", "do", "da", "du", "di", "van", "der", "the", "a", "an")
# Fixed value: what a print driver puts before a file's name.
PRINT_DRIVER = "^microsoft\\s+(word|powerpoint|excel)\\s*[-–]\\s*"
# White space as it is trimmed, and roman numerals of page numbers.
SPACE = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
ROMAN = "m{0,4}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
PAGE_NUMBER = f"^{SPACE}*(?:{ROMAN}|{ROMAN.upper()}|[0-9]{{1,4}}|[Pp]age{SPACE}+[0-9]{{1,4}})(?:{SPACE}|\\.)*$"
LETTER_I = f"^{SPACE}*I(?:{SPACE}|\\.)*$"


def sniff(content: Column, path: Column) -> Column:
    """Format by content first, then by extension: pdf, zip (see ``ooxml_kind``), epub, html, md, txt, ole, binary."""
    head = F.substring(content, 1, 512)
    hexed = F.hex(head)
    text = F.decode(head, "ISO-8859-1")
    low = F.lower(F.regexp_replace(text, "^[\\s\\u00ef\\u00bb\\u00bf]+", ""))
    ext = F.lower(F.regexp_extract(path, "(\\.[^./]*)$", 1))
    epub = F.hex(F.encode(F.lit("mimetypeapplication/epub+zip"), "US-ASCII"))
    return (
        F.when(hexed.startswith("255044462D"), "pdf")
        .when(hexed.startswith("504B") & (F.substring(hexed, 61, 56) == epub), "epub")
        .when(hexed.startswith("504B"), "zip")
        .when(hexed.startswith("D0CF11E0A1B11AE1"), "ole")
        .when(hexed.rlike("^(..)*00"), "binary")
        .when(low.startswith("<!doctype html") | low.startswith("<html") | ext.isin(".html", ".htm"), "html")
        .when(ext.isin(".md", ".markdown") | text.startswith("---\n") | text.startswith("---\r\n"), "md")
        .otherwise("txt")
    )


def ooxml_kind(content: bytes) -> str | None:
    """docx or pptx by the folders an archive holds; None if it has both or neither, or is corrupt."""
    try:
        with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
            names = z.namelist()
    except (zipfile.BadZipFile, OSError):
        return None
    word, slides = any(n.startswith("word/") for n in names), any(n.startswith("ppt/") for n in names)
    return "docx" if word and not slides else "pptx" if slides and not word else None


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds = []
        for path, content, sniffed in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), batch.column("format").to_pylist()):
            if sniffed == "zip":
                ext = path.lower().rsplit(".", 1)[-1]
                sniffed = ooxml_kind(content) or (ext if ext in ("docx", "pptx") else "binary")
            kinds.append(sniffed)
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("content"), pa.array(kinds, pa.string())], ["path", "content", "format"])


def route(files: DataFrame, ocr: bool = True, probes: DataFrame | None = None) -> DataFrame:
    """(path, content, format, engine, refusal) of files (path, content), in one pass over them.

    Zip archives are looked into, formats that are not read are refused by name.  ``probes`` (path, image_only, garbled,
    see ``probe``) tells of PDF files whose text layer is of no use: they are recognised from their images (all pages,
    if the layer is garbled and there is more than images), or refused where recognition is off.
    """
    first = files.select("path", "content", sniff(F.col("content"), F.col("path")).alias("format"))
    kinds = first.mapInArrow(_kinds, "path string, content binary, format string")
    refusal = F.create_map(*[F.lit(x) for pair in REFUSALS.items() for x in pair])[F.col("format")]
    if probes is None:
        kinds = kinds.withColumn("image_only", F.lit(False)).withColumn("garbled", F.lit(False))
    else:
        kinds = kinds.join(probes.select("path", "image_only", "garbled"), "path", "left")
    poor = F.coalesce((F.col("format") == "pdf") & (F.col("image_only") | F.col("garbled")), F.lit(False))
    off = poor & F.lit(not ocr)
    return kinds.select(
        "path", "content", "format",
        F.when(refusal.isNull() & ~off, F.when(poor, "ts-ocr").otherwise("ts-fast")).alias("engine"),
        (poor & ~F.col("image_only")).alias("force_ocr"),
        F.coalesce(refusal, F.when(off, F.lit("the text layer cannot be used and recognition is off"))).alias("refusal"),
    )


def sample_pages(pages: Column, most: int = 8) -> Column:
    """Sorted page numbers to look at: spread over the document, the last one always among them."""
    n = pages.cast("int")
    count = F.least(F.lit(most), F.greatest(F.lit(1), F.least(n, F.greatest(F.lit(1), F.ceil(n / 40.0).cast("int")))))
    target = F.greatest(count, F.least(n, F.lit(3)))
    spread = F.transform(F.sequence(F.lit(0), target - 1), lambda i: (F.floor(i * n / target) + 1).cast("int"))
    return F.when(n >= 1, F.array_sort(F.array_distinct(F.concat(spread, F.array(n))))).otherwise(F.array().cast("array<int>"))


def text_layer_ratios(text: Column) -> dict[str, Column]:
    """Shares of a text that are glyph escapes, printable characters and replacement characters."""
    size = F.greatest(F.length(text), F.lit(1))
    escapes = F.aggregate(F.regexp_extract_all(text, F.lit("(?i)/(?:g|uni|c|cid|i)\\d+"), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    printable = F.length(F.regexp_replace(text, "[^\\p{L}\\p{N}\\p{P}\\p{S}\\s]", ""))
    return {"escapes": escapes / size, "printable": printable / size, "replaced": F.regexp_count(text, F.lit("\\x{FFFD}")) / size}


def usable_text_layer(text: Column) -> Column:
    r = text_layer_ratios(text)
    return (r["escapes"] <= 0.1) & (r["printable"] >= 0.6) & (r["replaced"] <= 0.02)


def probe(pages: DataFrame) -> DataFrame:
    """(document_id, sampled, textual, image_only, garbled) of sampled pages (document_id, text, has_image)."""
    body = F.coalesce("text", F.lit(""))
    marked = pages.withColumn("textual", F.length(F.trim(body)) >= 20).withColumn("bad", (F.length(F.trim(body)) >= 20) & ~usable_text_layer(body))
    out = marked.groupBy("document_id").agg(F.count("*").alias("sampled"), F.count_if("textual").alias("textual"), F.count_if(~F.col("textual") & F.col("has_image")).alias("imagery"), F.count_if("bad").alias("bad"))
    image_only = (F.col("imagery") > 0) & (F.col("textual") / F.col("sampled") <= 0.25)
    garbled = (F.col("textual") > 0) & (F.col("bad") / F.greatest("textual", F.lit(1)) >= 0.5)
    engine = F.when(image_only | garbled, "ts-ocr").otherwise("ts-fast")
    return out.select("document_id", "sampled", "textual", image_only.alias("image_only"), garbled.alias("garbled"), engine.alias("engine"))


def usable_title(title: Column) -> Column:
    """The trimmed title, or null if it is empty, a file name or a print driver's, or says nothing once the names of
    products, generic words, fillers and numbers are taken out."""
    bare = F.regexp_replace(title, f"^{SPACE}+|{SPACE}+$", "")
    rest = bare
    for parts, after in ((PRODUCTS, "\\b"), (GENERIC, "\\d*\\b"), (FILLERS, "\\b")):
        rest = F.regexp_replace(rest, f"(?iu)\\b({'|'.join(parts)}){after}", " ")
    silent = F.regexp_replace(rest, "[^\\p{L}\\p{N}]+|[0-9]+", "") == ""
    bad = bare.isNull() | bare.rlike(f"(?i){PRINT_DRIVER}") | bare.rlike("(?i)\\.[a-z0-9]{2,4}$") | silent
    return F.when(~bad, bare)


def chosen_title(given: Column, parsed: Column, path: Column) -> Column:
    """The caller's title, else the parser's, else the file's name; blank ones count as absent."""
    full = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(full(given), full(parsed), F.element_at(F.split(path, "/"), -1))


def page_number_line(text: Column) -> Column:
    """A line that is only a page number: 1 to 4 digits, ``Page n``, or a roman numeral in one case; blanks and dots may
    follow.  ``I`` is a word."""
    return F.coalesce(text.rlike(PAGE_NUMBER) & ~text.rlike(LETTER_I) & (F.regexp_replace(text, SPACE, "") != ""), F.lit(False))
