"""PDF text runs to blocks: lines, columns, furniture, headings; and the vote between text layer and recognition.

Raw PDF bytes are not read here; the input is what a PDF reader gives: text runs (text, a, b, c, d, x, y, width,
height) per page, and lines recognised on page images.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from quire.operators.chunker import Block
from quire.sources.route import FILLERS, GENERIC, LETTER_I, PAGE_NUMBER, PRINT_DRIVER, PRODUCTS

TOLERANCE, WIDE, WORD_GAP, BAND_GAP = 2.0, 0.8, 0.2, 2.5
HEADING, TIERS, SIZE_STEP = 1.15, 6, 0.5
CONFIDENT, ENOUGH_TEXT = 40, 50


@dataclass
class Run:
    """A piece of text with its matrix (a b c d), place and extent."""

    text: str
    x: float
    y: float
    width: float
    size: float
    a: float = 1.0
    b: float = 0.0


@dataclass
class Line:
    text: str
    x0: float
    x1: float
    baseline: float
    top: float
    size: float


def _table(runs: Iterable[Run]) -> np.ndarray:
    """Upright runs that are not blank as rows (x0, x1, baseline, size), top of the page first, with their text apart."""
    kept = [r for r in runs if r.text.strip() and abs(r.b) <= abs(r.a)]
    kept.sort(key=lambda r: -r.y)
    out = np.array([(r.x, r.x + r.width, r.y, r.size) for r in kept], dtype=float).reshape(-1, 4)
    return out, np.array([r.text for r in kept], dtype=object)


def _baselines(y: np.ndarray) -> np.ndarray:
    """Row number of each run, of baselines in falling order; a row takes what is within the tolerance of its first."""
    rows = np.zeros(len(y), dtype=int)
    first = 0
    for k in range(1, len(y)):
        new = y[first] - y[k] > TOLERANCE
        rows[k] = rows[k - 1] + new
        first = k if new else first
    return rows


def _line(at: np.ndarray, text: np.ndarray) -> Line:
    order = np.argsort(at[:, 0], kind="stable")
    at, text = at[order], text[order]
    size = float(at[:, 3].max())
    out = text[0]
    for k in range(1, len(text)):
        apart = at[k, 0] - at[k - 1, 1] > WORD_GAP * size and not out.endswith(" ")
        out += (" " if apart else "") + text[k]
    y = float(at[0, 2])
    return Line(re.sub(r"\s+", " ", out).strip(), float(at[:, 0].min()), float(at[:, 1].max()), y, y + size, size)


def _gutter(size: float, width: float) -> float:
    return max(1.2 * size, 0.03 * width)


def _column_of(at: np.ndarray, row: np.ndarray, lo: float, hi: float, buckets: int = 240) -> np.ndarray | None:
    """Column of each run of a band, by its middle (-1: inside a gutter); None if the band is one column.

    A gutter is a stretch of the page's width, wide enough and inside it, that no run covers; a column has text in two
    rows or more."""
    width = hi - lo
    heights = np.array([at[row == r, 3].max() for r in np.unique(row)])
    if len(heights) < 3 or width <= 0:
        return None
    # runs that begin less runs that end, summed over the width: places where it is zero are free
    change = np.zeros(buckets + 1, dtype=int)
    np.add.at(change, np.clip(np.floor((at[:, 0] - lo) / width * buckets), 0, buckets).astype(int), 1)
    np.add.at(change, np.clip(np.ceil((at[:, 1] - lo) / width * buckets), 0, buckets).astype(int), -1)
    turns = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(change[:buckets]) <= 0, [False]])))
    free = [(lo + a * width / buckets, lo + b * width / buckets) for a, b in turns.reshape(-1, 2) if a > 0 and b < buckets]
    free = [(a, b) for a, b in free if b - a >= _gutter(np.sort(heights)[len(heights) // 2], width)]
    if not free:
        return None
    left, right = np.array([lo, *(b for _, b in free)]), np.array([*(a for a, _ in free), hi + 1])
    middle = at[:, :2].mean(1)
    column = np.searchsorted(left, middle, side="right") - 1
    column = np.where((column >= 0) & (middle < right[column]), column, -1)
    full = all(len(np.unique(row[column == c])) >= 2 for c in range(len(left)))
    return column if full else None


def assemble_lines(runs: Iterable[Run], columns: bool = True) -> list[Line]:
    """Reading order: bands between full-width rows and large gaps, within a band column after column (unless the page
    is known to have one)."""
    at, text = _table(runs)
    if not len(at):
        return []
    row = _baselines(at[:, 2])
    lo, hi = float(at[:, 0].min()), float(at[:, 1].max())
    members = [np.flatnonzero(row == r) for r in range(row[-1] + 1)]
    height = np.array([at[m, 3].max() for m in members])
    base = np.array([at[m[0], 2] for m in members])

    def unbroken(m: np.ndarray, size: float) -> bool:
        part = at[m[np.argsort(at[m, 0], kind="stable")]]
        gap = (part[1:, 0] - part[:-1, 1]).max(initial=0.0)
        return hi > lo and part[:, 1].max() - part[:, 0].min() >= WIDE * (hi - lo) and gap < _gutter(size, hi - lo)

    wide = np.array([unbroken(m, h) for m, h in zip(members, height)])
    far = np.concatenate([[False], base[:-1] - base[1:] > BAND_GAP * np.maximum(height[:-1], height[1:])])
    band = np.cumsum(far | wide | np.concatenate([[False], wide[:-1]]))
    out: list[Line] = []
    for b in np.unique(band):
        rows = np.flatnonzero(band == b)
        own = np.concatenate([members[r] for r in rows])
        column = _column_of(at[own], row[own], lo, hi) if columns else None
        column = np.zeros(len(own), dtype=int) if column is None else column
        for c in range(column.max(initial=0) + 1):
            for r in rows:
                part = own[(column == c) & (row[own] == r)]
                if len(part):
                    out.append(_line(at[part], text[part]))
    return [x for x in out if x.text]


_NUMBER, _I = re.compile(PAGE_NUMBER), re.compile(LETTER_I)


def is_page_number(text: str) -> bool:
    """As ``route.page_number_line``."""
    return bool(text.strip() and _NUMBER.match(text) and not _I.match(text))


def usable_title(title: str | None) -> str | None:
    """As ``route.usable_title``."""
    bare = (title or "").strip()
    rest = bare
    for parts, after in ((PRODUCTS, r"\b"), (GENERIC, r"\d*\b"), (FILLERS, r"\b")):
        rest = re.sub(rf"(?i)\b({'|'.join(parts)}){after}", " ", rest)
    silent = not re.sub(r"[\W_]+|\d+", "", rest)
    return None if silent or re.match(f"(?i){PRINT_DRIVER}", bare) or re.search(r"(?i)\.[a-z0-9]{2,4}$", bare) else bare


def poor_text_layer(pages: list[list[Run]], images: list[bool] | None) -> str | None:
    """Why the text layer of a file is of no use, judged by a few of its pages (see ``route.probe``); None if it is."""
    n = len(pages)
    target = max(min(8, max(1, min(n, -(-n // 40)))), min(n, 3))
    sampled = sorted({k * n // target for k in range(target)} | {n - 1}) if n else []
    textual = imagery = bad = 0
    for k in sampled:
        text = " ".join(r.text for r in pages[k]).strip()
        if len(text) >= 20:
            textual += 1
            escapes = sum(len(m) for m in re.findall(r"(?i)/(?:g|uni|c|cid|i)\d+", text)) / len(text)
            shown = sum(c.isprintable() or c.isspace() for c in text) / len(text)
            bad += escapes > 0.1 or shown < 0.6 or text.count("\ufffd") / len(text) > 0.02
        elif images and images[k]:
            imagery += 1
    if imagery and textual / len(sampled) <= 0.25:
        return "the pages are images"
    return "the text layer is garbled" if textual and bad / textual >= 0.5 else None


@dataclass
class Analysis:
    """What a sample of pages says of a document: body size, heading sizes, running text."""

    body: float
    tiers: list[float]
    running: set[str]
    trust: bool

    def level(self, size: float) -> int | None:
        """Heading level by size: sampled tiers by rank, other sizes by magnitude, 6 at most."""
        if not self.trust or size < HEADING * self.body:
            return None
        above = sum(1 for t in self.tiers if t > size + SIZE_STEP)
        return min(TIERS, above + 1)


def analyse(pages: list[list[Line]], most: int = 20) -> Analysis:
    """Char-weighted most frequent size at half points; first and last lines on half of the sampled pages, 3 at least."""
    step = max(1, -(-len(pages) // most))
    sampled = pages[::step]
    weight: Counter = Counter()
    edges: Counter = Counter()
    for lines in sampled:
        for x in lines:
            weight[round(x.size * 2) / 2] += len(x.text)
        edges.update({re.sub(r"\d+", "#", x.text.lower()) for x in (lines[:1] + lines[-1:])})
    body = max(weight, key=lambda s: (weight[s], -s)) if weight else 0.0
    tiers = sorted((s for s in weight if s >= HEADING * body), reverse=True)
    heads = sum(x.size >= HEADING * body for lines in sampled for x in lines)
    running = {t for t, n in edges.items() if n >= max(3, 0.5 * len(sampled))}
    return Analysis(body, tiers, running, len(tiers) <= TIERS or heads / max(1, len(sampled)) <= 3)


def join_wrapped(lines: Iterable[str]) -> str:
    """Lines as one text; a hyphen at a line end is healed."""
    out = ""
    for line in lines:
        out = out[:-1] + line if out and out[-1] in "-‐" else f"{out} {line}" if out else line
    return out


def bbox(lines: list[Line], width: float, height: float) -> list[float]:
    """(x, y, w, h) in 0..1 from the top left."""
    x0, x1 = min(x.x0 for x in lines), max(x.x1 for x in lines)
    top, low = max(x.top for x in lines), min(x.baseline for x in lines)
    clip = lambda v: min(1.0, max(0.0, v))
    return [clip(x0 / width), clip(1 - top / height), clip((x1 - x0) / width), clip((top - low) / height)]


def bookmark_trails(bookmarks: list[tuple[str, int | None, int]]) -> dict[int, list[str]]:
    """Trail of titles by page index, of bookmarks (title, page index or None if broken, depth); a page's first counts."""
    out: dict[int, list[str]] = {}
    trail: list[str] = []
    for title, page, depth in bookmarks:
        trail = [*trail[:depth], re.sub(r"\s+", " ", title).strip()]
        if page is not None:
            out.setdefault(page, list(trail))
    return out


def pdf_blocks(pages: list[list[Run]], width: float = 612, height: float = 792, bookmarks: list[tuple[str, int | None, int]] = ()) -> Iterator[Block]:
    """Blocks of a text-layer PDF, one locator a page."""
    assembled = [assemble_lines(p) for p in pages]
    seen = analyse(assembled)
    marks = bookmark_trails(list(bookmarks))
    stack: list[tuple[float, str]] = []
    for n, lines in enumerate(assembled):
        if n in marks:
            stack = [(float("inf"), t) for t in marks[n]]
        keep = [x for k, x in enumerate(lines) if not ((k in (0, len(lines) - 1)) and re.sub(r"\d+", "#", x.text.lower()) in seen.running) and not is_page_number(x.text)]
        held: list[Line] = []

        def flush(held: list[Line] = held, n: int = n) -> Iterator[Block]:
            if held:
                yield Block("paragraph", join_wrapped(x.text for x in held), str(n + 1), n, [t for _, t in stack], bbox(held, width, height))
                held.clear()

        k = 0
        right = max((x.x1 for x in keep), default=0)
        while k < len(keep):
            line = keep[k]
            level = seen.level(line.size)
            if level is not None:
                yield from flush()
                head = [line]
                while k + 1 < len(keep) and len(head) < 4:
                    nxt = keep[k + 1]
                    same = abs(nxt.size - line.size) < SIZE_STEP and 0 < head[-1].baseline - nxt.baseline <= 2 * line.size
                    wraps = head[-1].x1 >= right - 2 * line.size or abs((head[-1].x0 + head[-1].x1) - (nxt.x0 + nxt.x1)) < 2 * line.size
                    if not (same and wraps and sum(len(x.text) for x in [*head, nxt]) <= 200):
                        break
                    head.append(nxt)
                    k += 1
                text = join_wrapped(x.text for x in head)
                same_section = bool(stack) and stack[-1][1].lower().endswith(text.lower())
                if not same_section:
                    while stack and stack[-1][0] <= line.size:
                        stack.pop()
                    yield Block("heading", text, str(n + 1), n, [t for _, t in stack], bbox(head, width, height), level)
                    stack.append((line.size, text))
            else:
                if held:
                    gap = held[-1].baseline - line.baseline
                    if gap > 1.6 * line.size or gap < 0 or abs(line.size - held[-1].size) > 0.6:
                        yield from flush()
                held.append(line)
            k += 1
        yield from flush()


def scanned_blocks(pages: list[dict], force: bool = False) -> Iterator[Block]:
    """Blocks of a scanned document: per page the text layer if it has enough usable text, else recognised lines.

    A page has ``text`` (its layer), ``lines`` of (text, confidence) and ``usable``; trails come from ``trail`` alone
    and are carried forward.  Lines below the confidence limit and page numbers are dropped.
    """
    trail: list[str] = []
    for n, page in enumerate(pages):
        trail = page.get("trail") or trail
        layer = (page.get("text") or "").strip()
        if not force and len(layer) >= ENOUGH_TEXT and page.get("usable", True):
            parts = [p.strip() for p in re.split(r"\n\s*\n", layer)]
        else:
            parts = [join_wrapped([t]) for t, sure in page.get("lines", []) if sure >= CONFIDENT]
        for p in parts:
            if p and not is_page_number(p):
                yield Block("paragraph", join_wrapped(p.split("\n")), str(n + 1), n, list(trail))
