"""Splitters of over-budget text: prose, words, lists, code and tables, by estimated tokens."""

from __future__ import annotations

import re

_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s")
_SENTENCE = re.compile(r"[^.!?]+(?:[.!?]+[\"')\]]*\s*|$)")
_RULE = re.compile(r"\s*\|?[\s:|-]+\|?\s*")


def utf16_len(text: str) -> int:
    return len(text) + len(_ASTRAL.findall(text))


def estimate(text: str) -> int:
    """ceil((UTF-16 length - cjk) / 4) + cjk."""
    cjk = len(_CJK.findall(text))
    return -(-(utf16_len(text) - cjk) // 4) + cjk


def take_last(text: str, n: int) -> str:
    """About the last ``n`` tokens: the last 4n UTF-16 units, moved forward to a sentence or word start."""
    units = text.encode("utf-16-le", "surrogatepass")
    if len(units) // 2 <= 4 * n:
        return text
    tail = units[-8 * n :].decode("utf-16-le", "replace") if n > 0 else ""
    stop = tail.find(". ")
    if 0 <= stop < 2 * n:
        tail = tail[stop + 2 :]
    elif (blank := tail.find(" ")) >= 0:
        tail = tail[blank + 1 :]
    return tail.lstrip()


def _pack(units: list[str], budget: int, sep: str = "", over=None, extra: int = 0) -> list[str]:
    """Greedy packing of units in order; a unit beyond the budget is handed to ``over`` or stays whole.

    ``extra`` tokens are taken off the budget of every part, for what is put around it later."""
    out: list[str] = []
    now: list[str] = []
    for unit in units:
        giant = over is not None and estimate(unit) > budget
        if now and (giant or estimate(sep.join([*now, unit])) + extra > budget):
            out.append(sep.join(now))
            now = []
        if giant:
            out += over(unit)
        else:
            now.append(unit)
    return [*out, sep.join(now)] if now else out


def _trimmed(parts: list[str]) -> list[str]:
    return [t for p in parts if (t := p.strip())]


def split_words(text: str, budget: int) -> list[str]:
    return _trimmed(_pack([w for w in re.split(r"(\s+)", text) if w], budget))


def split_prose(text: str, budget: int) -> list[str]:
    """Whole sentences up to the budget; a sentence beyond it by words.

    A text within the budget comes back as it is; of a longer one a leading run of . ! ? is lost, unless it is all."""
    if estimate(text) <= budget:
        return [text]
    sentences = _SENTENCE.findall(text) or [text]
    return _trimmed(_pack(sentences, budget, over=lambda s: split_words(s, budget))) or [text]


def split_list(text: str, budget: int) -> list[str]:
    """Whole items with their continuation lines; an item beyond the budget as prose."""
    items: list[str] = []
    for line in text.split("\n"):
        if _ITEM.match(line) or not items:
            items.append(line)
        else:
            items[-1] += "\n" + line
    return _pack(items, budget, "\n", lambda s: split_prose(s, budget)) or [text]


def split_code(text: str, budget: int) -> list[str]:
    """Whole lines, a fence with the language around every part; a line beyond the budget stays whole."""
    if estimate(text) <= budget:
        return [text]
    fence, *rest = text.split("\n")
    if fence.startswith("```"):
        body = rest[:-1] if rest and rest[-1] == "```" else rest
    else:
        fence, body = "```", [fence, *rest]
    parts = _pack(body, budget, "\n", extra=estimate(f"{fence}\n\n```"))
    return [f"{fence}\n{p}\n```" for p in parts] or [text]


def split_table(text: str, budget: int) -> list[str]:
    """Groups of rows, the header and its rule above every part; text without such a rule as prose."""
    if estimate(text) <= budget:
        return [text]
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) < 2 or not _RULE.fullmatch(lines[1]):
        return split_prose(text, budget)
    head = "\n".join(lines[:2])
    return [f"{head}\n{p}" for p in _pack(lines[2:], budget, "\n", extra=estimate(head))] or [text]


SPLITTERS = {"list": split_list, "code": split_code, "table": split_table}


def split_block(kind: str, text: str, budget: int) -> list[str]:
    return SPLITTERS.get(kind, split_prose)(text, budget)
