"""Text measures as Catalyst expressions: UTF-16 length, token estimates, terms, token counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character ranges that count one token each.
CJK = "[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]"
ASTRAL = "[\\x{10000}-\\x{10FFFF}]"
TERM = "[\\p{L}\\p{N}]+"
WORDPUNCT = "(?U)[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]+"
TRIM = "(?U)^[\\s﻿]+|[\\s﻿]+$"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return F.length(text) + F.regexp_count(text, F.lit(ASTRAL))


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CJK))


def estimate_tokens(text: Column) -> Column:
    """ceil((UTF-16 length - cjk) / 4) + cjk as int; null stays null."""
    cjk = cjk_count(text)
    return (F.ceil((utf16_length(text) - cjk) / F.lit(4.0)) + cjk).cast("int")


def wordpunct_count(text: Column) -> Column:
    """Tokens of the public word/punctuation tokenizer."""
    return F.regexp_count(text, F.lit(WORDPUNCT))


def terms(text: Column) -> Column:
    """Maximal runs of letters or numbers of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def js_trim(text: Column) -> Column:
    """Trim Unicode white space and the byte order mark."""
    return F.regexp_replace(text, TRIM, "")
