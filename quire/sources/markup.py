"""Markdown, plain text and Word documents as block streams."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from quire.operators.chunker import Block
from quire.sources.files import open_zip

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_LIST = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])(?:\s+|$)")
_QUOTE = re.compile(r"^ {0,3}>")
_DELIMITER = re.compile(r"^ {0,3}\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
_LINE_END = re.compile("\r\n|\n|\r")
_HTML = re.compile(r"^ {0,3}<(?:[A-Za-z/!?])")


class Trail:
    """The open headings of a document and the locator its blocks are at."""

    def __init__(self) -> None:
        self.titles: list[str] = []
        self.ordinal = 0

    def heading(self, level: int, title: str, text: str) -> Block:
        if level <= 2:
            self.ordinal += 1
        above = self.titles[: level - 1]
        self.titles = [*above, title]
        return Block("heading", text, f"sec-{self.ordinal}", self.ordinal, above, None, level)

    def body(self, kind: str, text: str) -> Block:
        return Block(kind, text, f"sec-{self.ordinal}", self.ordinal, list(self.titles))


def plain_inline(text: str) -> str:
    """Text of inline markup: links and images by their label, emphasis and code marks dropped."""
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    return re.sub(r"[*`~]+|(?<!\w)_+|_+(?!\w)", "", text).strip()


def strip_frontmatter(source: str) -> tuple[str | None, str]:
    m = re.match(r"\A---[ \t]*\r?\n(.*?)\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|\Z)", source, re.S)
    return (m.group(1), source[m.end() :]) if m else (None, source)


def markdown_blocks(source: str) -> Iterator[Block]:
    """Top-level blocks, their text as it stands in the source; rules, html and front matter are dropped."""
    lines = _LINE_END.split(strip_frontmatter(source)[1])
    trail, i, n = Trail(), 0, 0
    n = len(lines)
    while i < n:
        line, start = lines[i], i
        if not line.strip():
            i += 1
            continue
        if m := _FENCE.match(line):
            close = re.compile(r"^ {0,3}" + re.escape(m.group(1)[0]) + "{" + str(len(m.group(1))) + r",}\s*$")
            i += 1
            while i < n and not close.match(lines[i]):
                i += 1
            i = min(i + 1, n)
            yield trail.body("code", "\n".join(lines[start:i]).strip())
        elif m := _ATX.match(line):
            i += 1
            yield trail.heading(len(m.group(1)), plain_inline(m.group(2) or ""), line.strip())
        elif _RULE.match(line):
            i += 1
        elif _QUOTE.match(line):
            while i < n and lines[i].strip() and (_QUOTE.match(lines[i]) or not _interrupts(lines[i])):
                i += 1
            yield trail.body("quote", "\n".join(lines[start:i]).strip())
        elif _LIST.match(line):
            i += 1
            while i < n:
                if not lines[i].strip():
                    j = i
                    while j < n and not lines[j].strip():
                        j += 1
                    if j < n and (_LIST.match(lines[j]) or lines[j].startswith(("  ", "\t"))):
                        i = j
                        continue
                    break
                if not _LIST.match(lines[i]) and not lines[i].startswith((" ", "\t")) and _interrupts(lines[i]):
                    break
                i += 1
            yield trail.body("list", "\n".join(lines[start:i]).strip())
        elif line.startswith(("    ", "\t")):
            while i < n and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                i += 1
            yield trail.body("code", "\n".join(lines[start:i]).strip())
        elif _HTML.match(line):
            while i < n and lines[i].strip():
                i += 1
        elif "|" in line and i + 1 < n and _DELIMITER.match(lines[i + 1]) and "-" in lines[i + 1]:
            while i < n and lines[i].strip() and (i < start + 2 or "|" in lines[i]):
                i += 1
            yield trail.body("table", "\n".join(lines[start:i]).strip())
        else:
            i += 1
            level = 0
            while i < n and lines[i].strip():
                if s := re.match(r"^ {0,3}(=+|-+)\s*$", lines[i]):
                    level = 1 if s.group(1)[0] == "=" else 2
                    i += 1
                    break
                if _interrupts(lines[i]):
                    break
                i += 1
            text = "\n".join(lines[start:i]).strip()
            if level:
                yield trail.heading(level, plain_inline(" ".join(text.split("\n")[:-1])), text)
            else:
                yield trail.body("paragraph", text)


def _interrupts(line: str) -> bool:
    return bool(_FENCE.match(line) or _ATX.match(line) or _RULE.match(line) or _QUOTE.match(line) or _LIST.match(line))


def markdown_metadata(source: str, name: str) -> tuple[str, int]:
    """(title, locator count): the front matter's title, else the first top heading's, else the name."""
    front, body = strip_frontmatter(source)
    heads, fenced, first = 0, False, None
    for line in _LINE_END.split(body):
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced and (m := re.match(r"^(#{1,2})\s+(.*)$", line)):
            heads += 1
            if len(m.group(1)) == 1 and first is None:
                first = plain_inline(m.group(2))
    named = re.search(r"^title:\s*[\"']?(.*?)[\"']?\s*$", front, re.M) if front else None
    return (named.group(1) if named and named.group(1) else None) or first or name, max(1, heads)


_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+\S")
_NUMBERED = re.compile(r"^(\d+(?:\.\d+)*)\.?\s+\S")


def heading_level(line: str, following: str | None) -> int | None:
    """Level of a plain-text heading, judged by the line and the next one."""
    bare = line.strip()
    after = (following or "").strip()
    if not bare or len(bare) > 90:
        return None
    numbered = _NUMBERED.match(bare)
    if _ITEM.match(line) and not (numbered and "." not in numbered.group(1) and not after):
        return None
    if re.fullmatch(r"={3,}", after):
        return 1
    if re.fullmatch(r"-{3,}", after):
        return 2
    closed = bare[-1] in ".!?"
    if numbered and not closed:
        return min(6, numbered.group(1).count(".") + 1)
    if re.match(r"(?i)(chapter|part|section|appendix|book)\b", bare):
        return 1
    if not closed and bare == bare.upper() and any(c.isupper() for c in bare):
        return 2
    return None


def text_blocks(source: str) -> Iterator[Block]:
    """Headings, lists and paragraphs of plain text; only line feeds, with or without a return, end a line."""
    lines, trail = re.split("\r?\n", source), Trail()
    kept: list[str] = []
    kind = "paragraph"

    def flush() -> Iterator[Block]:
        if kept:
            yield trail.body(kind, "\n".join(kept).strip())
            kept.clear()

    skip = False
    for n, line in enumerate(lines):
        if skip:
            skip = False
            continue
        following = lines[n + 1] if n + 1 < len(lines) else None
        level = heading_level(line, following)
        if level is not None:
            yield from flush()
            kind = "paragraph"
            yield trail.heading(level, line.strip(), line.strip())
            skip = bool(re.fullmatch(r"={3,}|-{3,}", (following or "").strip()))
        elif not line.strip():
            yield from flush()
            kind = "paragraph"
        elif _ITEM.match(line):
            if kind != "list":
                yield from flush()
                kind = "list"
            kept.append(line)
        else:
            kept.append(line)
    yield from flush()


def text_metadata(source: str, name: str) -> tuple[str, int]:
    heads = [b for b in text_blocks(source) if b.kind == "heading" and (b.level or 9) <= 2]
    return (heads[0].text if heads else name), max(1, len(heads))


def gfm_table(rows: list[list[str]]) -> str | None:
    """A pipe table with the first row as header; None without header cells; empty rows are dropped."""
    cells = [[re.sub(r"\s+", " ", c).strip().replace("|", "\\|") for c in r] for r in rows]
    if not cells or not cells[0]:
        return None
    line = lambda r: "| " + " | ".join(r) + " |"
    body = [line(r) for r in cells[1:] if any(r)]
    return "\n".join([line(cells[0]), line(["---"] * len(cells[0])), *body])


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attr(el: ElementTree.Element | None, name: str) -> str | None:
    return next((v for k, v in el.attrib.items() if _local(k) == name), None) if el is not None else None


def _first(el: ElementTree.Element, name: str) -> ElementTree.Element | None:
    return next((x for x in el.iter() if _local(x.tag) == name), None)


def _run_text(el: ElementTree.Element) -> str:
    parts = []
    for x in el.iter():
        tag = _local(x.tag)
        parts.append((x.text or "") if tag == "t" else " " if tag in ("tab", "br", "cr") else "")
    return re.sub(r"\s+", " ", "".join(parts)).strip()


def _style_level(style: str) -> int | None:
    m = re.fullmatch(r"(?i)heading\s?([1-6])", style)
    return int(m.group(1)) if m else 1 if style.lower() == "title" else None


def _notes(archive: dict[str, bytes], kind: str) -> dict[str, str]:
    part = archive.get(f"word/{kind}s.xml")
    if not part:
        return {}
    found = [x for x in ElementTree.fromstring(part) if _local(x.tag) == kind]
    return {_attr(x, "id") or "": _run_text(x) for x in found if _attr(x, "type") in (None, "normal")}


def docx_blocks(content: bytes) -> Iterator[Block]:
    """Body paragraphs, lists, quotes and tables of a Word document, notes after the block that cites them."""
    archive = open_zip(content, lambda name, size: name.startswith("word/") and name.endswith(".xml"))
    body = next((x for x in ElementTree.fromstring(archive["word/document.xml"]) if _local(x.tag) == "body"), None)
    if body is None or not len(body):
        raise ValueError("the document is empty")
    notes = {k: _notes(archive, k) for k in ("footnote", "endnote")}
    numbers = {"footnote": 0, "endnote": 0}
    trail, items, pending = Trail(), [], []

    def cited(el: ElementTree.Element) -> list[str]:
        out = []
        for x in el.iter():
            kind = {"footnoteReference": "footnote", "endnoteReference": "endnote"}.get(_local(x.tag))
            if kind and (text := notes[kind].get(_attr(x, "id") or "")):
                numbers[kind] += 1
                out.append(f"[{kind} {numbers[kind]}] {text}")
        return out

    def close() -> Iterator[Block]:
        if items:
            yield trail.body("list", "\n".join(items))
            items.clear()
        for note in pending:
            yield trail.body("caption", note)
        pending.clear()

    for el in body:
        tag = _local(el.tag)
        if tag == "tbl":
            yield from close()
            rows = [[_run_text(c) for c in r if _local(c.tag) == "tc"] for r in el if _local(r.tag) == "tr"]
            if table := gfm_table(rows):
                yield trail.body("table", table)
            pending += cited(el)
            yield from close()
        elif tag == "p":
            text, style = _run_text(el), _attr(_first(el, "pStyle"), "val") or ""
            level, listed = _style_level(style), _first(el, "numPr")
            if not text:
                pending += cited(el)
                continue
            if level is None and listed is not None:
                depth = int(_attr(_first(listed, "ilvl"), "val") or 0)
                items.append("  " * depth + "- " + text)
                pending += cited(el)
                continue
            yield from close()
            if level is not None:
                yield trail.heading(level, text, "#" * level + " " + text)
            elif re.search("quote", style, re.I):
                yield trail.body("quote", "> " + text)
            else:
                yield trail.body("paragraph", text)
            pending += cited(el)
            yield from close()
    yield from close()


def as_docx(text: str) -> bytes:
    """A Word document with a paragraph for each line of the text."""
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    root = ElementTree.Element(f"{{{space}}}document")
    body = ElementTree.SubElement(root, f"{{{space}}}body")
    for line in text.split("\n"):
        run = ElementTree.SubElement(ElementTree.SubElement(body, f"{{{space}}}p"), f"{{{space}}}r")
        # control characters cannot stand in XML
        ElementTree.SubElement(run, f"{{{space}}}t").text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", " ", line)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", ElementTree.tostring(root, encoding="utf-8", xml_declaration=True))
    return out.getvalue()


def docx_metadata(content: bytes, name: str, blocks: list[Block] | None = None) -> tuple[str, int]:
    """(title, locator count) of a Word document; ``blocks`` are its blocks if they are known."""
    archive = open_zip(content, lambda n, size: n == "docProps/core.xml")
    core = archive.get("docProps/core.xml")
    title = _first(ElementTree.fromstring(core), "title") if core else None
    heads = [b for b in (docx_blocks(content) if blocks is None else blocks) if b.kind == "heading"]
    top = next((b.text.lstrip("# ") for b in heads if b.level == 1), None)
    return ((title.text or "").strip() if title is not None else "") or top or name, max(1, sum((b.level or 9) <= 2 for b in heads))


def parse_text(format: str, path: str, text: str) -> Iterator[Block]:
    """Blocks of a document given as text; Markdown by its format, all else as plain text."""
    return markdown_blocks(text) if format == "md" else text_blocks(text)
