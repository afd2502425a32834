"""Porter's suffix stripping (M. F. Porter, 1980), as the full-text index applies it to tokens of 3 to 64 bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The suffix tables of the published algorithm.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """One letter per character: c for a consonant, v for a vowel."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    shape = _shape(stem)
    return sum(1 for a, b in zip(shape, shape[1:]) if a + b == "vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, table: dict[str, str]) -> tuple[str, str] | None:
    ends = [s for s in table if word.endswith(s)]
    if not ends:
        return None
    end = max(ends, key=len)
    return word[: -len(end)], table[end]


def porter(word: str) -> str:
    """Stem of a lower-case token; others than 3 to 64 bytes stay as they are."""
    if not 3 <= len(word.encode()) <= 64:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            stem = word[: -len(end)]
            if word.endswith(end):
                if "v" in _shape(stem):
                    word = stem
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif _double(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _short(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        got = _longest(word, table)
        if got and _measure(got[0]) > 0:
            word = got[0] + got[1]
    ends = [s for s in _STEP4 if word.endswith(s)]
    if word.endswith("ion") and (not ends or len(max(ends, key=len)) < 3):
        stem = word[:-3]
        if stem.endswith(("s", "t")) and _measure(stem) > 1:
            word = stem
    elif ends:
        stem = word[: -len(max(ends, key=len))]
        if _measure(stem) > 1:
            word = stem
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def porter_udf(terms: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return terms.map(lambda t: known[t] if t in known else known.setdefault(t, porter(t)))


def stems_sql(words: str) -> str:
    """Common table expressions that end in stems (w, s): the stem of every w of ``words``, said in SQL.

    How often vowels and consonants change is told by patterns: C is a run of consonants, V of vowels."""
    c, v = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    over = [f"^({c})?{v}{c}", f"^({c})?{v}{c}{v}{c}"]  # more than 0, more than 1
    once, vowel, short = f"^({c})?{v}{c}({v})?$", f"^({c})?[aeiouy]", f"^{c}[aeiouy][^aeiouwxy]$"

    def stem(n: int) -> str:
        return f"left(s, len(s) - {n})"

    def has(text: str, pattern: str) -> str:
        return f"regexp_matches({text}, '{pattern}')"

    def table(ends: dict[str, str], least: int) -> str:
        order = sorted(ends, key=len, reverse=True)
        return "CASE " + " ".join(f"WHEN s LIKE '%{e}' THEN CASE WHEN {has(stem(len(e)), over[least])} THEN {stem(len(e))} || '{ends[e]}' ELSE s END" for e in order) + " ELSE s END"

    cut = {"ed": has(stem(2), vowel), "ing": has(stem(3), vowel)}
    last4 = table({e: "" for e in _STEP4}, 1)
    ion = f"WHEN s LIKE '%ion' THEN CASE WHEN {has(stem(3), '[st]$')} AND {has(stem(3), over[1])} THEN {stem(3)} ELSE s END "
    steps = [
        f"CASE WHEN s LIKE '%sses' OR s LIKE '%ies' THEN {stem(2)} WHEN s LIKE '%s' AND s NOT LIKE '%ss' THEN {stem(1)} ELSE s END AS s, false AS cut",
        f"CASE WHEN s LIKE '%eed' THEN CASE WHEN {has(stem(3), over[0])} THEN {stem(1)} ELSE s END WHEN s LIKE '%ed' THEN CASE WHEN {cut['ed']} THEN {stem(2)} ELSE s END WHEN s LIKE '%ing' THEN CASE WHEN {cut['ing']} THEN {stem(3)} ELSE s END ELSE s END AS s, s NOT LIKE '%eed' AND CASE WHEN s LIKE '%ed' THEN {cut['ed']} WHEN s LIKE '%ing' THEN {cut['ing']} ELSE false END AS cut",
        f"CASE WHEN NOT cut THEN s WHEN right(s, 2) IN ('at', 'bl', 'iz') THEN s || 'e' WHEN len(s) > 1 AND right(s, 1) = right({stem(1)}, 1) AND right(s, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z') THEN {stem(1)} WHEN {has('s', once)} AND {has('s', short)} THEN s || 'e' ELSE s END AS s, false AS cut",
        f"CASE WHEN s LIKE '%y' AND {has(stem(1), vowel)} THEN {stem(1)} || 'i' ELSE s END AS s, false AS cut",
        table(_STEP2, 0) + " AS s, false AS cut",
        table(_STEP3, 0) + " AS s, false AS cut",
        "CASE " + ion + last4[5:] + " AS s, false AS cut",
        f"CASE WHEN s LIKE '%e' AND ({has(stem(1), over[1])} OR {has(stem(1), once)} AND NOT {has(stem(1), short)}) THEN {stem(1)} ELSE s END AS s, false AS cut",
        f"CASE WHEN s LIKE '%ll' AND {has('s', over[1])} THEN {stem(1)} ELSE s END AS s, false AS cut",
    ]
    out = [f"st0 AS (SELECT w, w AS s, false AS cut FROM {words} WHERE strlen(w) BETWEEN 3 AND 64)"]
    out += [f"st{n} AS (SELECT w, {step} FROM st{n - 1})" for n, step in enumerate(steps, 1)]
    return ", ".join([*out, f"stems AS (SELECT w, s FROM st{len(steps)} UNION ALL SELECT w, w FROM {words} WHERE NOT strlen(w) BETWEEN 3 AND 64)"])
