"""Text runs of PDF files: objects, streams, page tree, fonts and text operators, as far as a text layer needs them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from quire.sources.pdf import Run

MOST_BYTES = 80_000_000
_DELIMITERS = b"()<>[]{}/%"
_SPACES = b"\0\t\n\f\r "
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")


class UnreadablePdf(ValueError):
    """The file is encrypted, too large inside, or not a PDF with pages."""


class Ref(int):
    """Number of an object that is named elsewhere."""


class Name(str):
    """A name such as /Page."""


class Keyword(str):
    """An operator."""


class Reader:
    """Objects out of bytes, one after the other."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def blank(self) -> None:
        d, n = self.data, len(self.data)
        while self.at < n:
            if d[self.at] in _SPACES:
                self.at += 1
            elif d[self.at] == 0x25:
                while self.at < n and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def next(self):
        """The next object, or None at the end; closing brackets come as keywords."""
        self.blank()
        d = self.data
        if self.at >= len(d):
            return None
        c = d[self.at]
        if c == 0x2F:
            return self._name()
        if c == 0x28:
            return self._string()
        if d[self.at : self.at + 2] == b"<<":
            self.at += 2
            return self._dict()
        if c == 0x3C:
            end = d.find(b">", self.at)
            end = len(d) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == 0x5B:
            self.at += 1
            out = []
            while (x := self.next()) is not None and x != Keyword("]"):
                self._put(out, x)
            return out
        if c in b"]{})":
            self.at += 1
            return Keyword(chr(c))
        if d[self.at : self.at + 2] == b">>":
            self.at += 2
            return Keyword(">>")
        start = self.at
        while self.at < len(d) and d[self.at] not in _SPACES and d[self.at] not in _DELIMITERS:
            self.at += 1
        word = d[start : self.at] or d[start : start + 1]
        self.at = max(self.at, start + 1)
        try:
            return int(word) if b"." not in word else float(word)
        except ValueError:
            return {b"true": True, b"false": False}.get(word, Keyword(word.decode("latin-1")))

    @staticmethod
    def _put(out: list, x) -> None:
        if x == "R" and isinstance(x, Keyword) and len(out) > 1 and isinstance(out[-2], int):
            out[-2:] = [Ref(out[-2])]
        else:
            out.append(None if isinstance(x, Keyword) and x == "null" else x)

    def _name(self) -> Name:
        self.at += 1
        start = self.at
        while self.at < len(self.data) and self.data[self.at] not in _SPACES and self.data[self.at] not in _DELIMITERS:
            self.at += 1
        return Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda m: chr(int(m.group(1), 16)), self.data[start : self.at].decode("latin-1")))

    def _string(self) -> bytes:
        out, depth = bytearray(), 1
        self.at += 1
        while self.at < len(self.data):
            c = self.data[self.at]
            self.at += 1
            if c == 0x5C:
                e = self.data[self.at : self.at + 1]
                self.at += 1
                if e in b"nrtbf" and e:
                    out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}[e]
                elif e and e in b"01234567":
                    m = re.compile(rb"[0-7]{1,3}").match(self.data, self.at - 1)
                    out.append(int(m.group(), 8) & 255)
                    self.at = m.end()
                elif e == b"\r":
                    self.at += self.data[self.at : self.at + 1] == b"\n"
                elif e != b"\n":
                    out += e
                continue
            depth += (c == 0x28) - (c == 0x29)
            if not depth:
                break
            out.append(c)
        return bytes(out)

    def _dict(self) -> dict:
        flat: list = []
        while (x := self.next()) is not None and x != Keyword(">>"):
            self._put(flat, x)
        return {k: v for k, v in zip(flat[::2], flat[1::2]) if isinstance(k, Name)}


class Document:
    """Objects of a file by number; those in object streams included."""

    def __init__(self, data: bytes) -> None:
        if not data.startswith(b"%PDF-"):
            raise UnreadablePdf("not a PDF file")
        self.data, self.objects, self.streams, self.inflated = data, {}, {}, 0
        trailer: dict = {}
        for m in _OBJECT.finditer(data):
            r = Reader(data, m.end())
            x, number = r.next(), int(m.group(1))
            self.objects[number] = x
            r.blank()
            if isinstance(x, dict) and data.startswith(b"stream", r.at):
                begin = r.at + 6
                begin += 2 if data[begin : begin + 2] == b"\r\n" else 1
                self.streams[number] = begin
                if x.get("Type") == "XRef":
                    trailer.update(x)
        for m in re.finditer(rb"\btrailer\b", data):
            got = Reader(data, m.end()).next()
            trailer.update(got if isinstance(got, dict) else {})
        if "Encrypt" in trailer:
            raise UnreadablePdf("the file is encrypted")
        for number in [n for n in self.streams if self.objects[n].get("Type") == "ObjStm"]:
            head = self.objects[number]
            body, first = self.stream(number), self.get(head.get("First")) or 0
            r = Reader(body)
            pairs = [r.next() for _ in range(2 * int(self.get(head.get("N")) or 0))]
            for n, offset in zip(pairs[::2], pairs[1::2]):
                if isinstance(n, int) and isinstance(offset, int):
                    self.objects.setdefault(n, Reader(body, first + offset).next())
        root = self.get(trailer.get("Root"))
        if not isinstance(root, dict):
            root = next((x for x in self.objects.values() if isinstance(x, dict) and x.get("Type") == "Catalog"), None)
        if root is None:
            raise UnreadablePdf("the file has no catalog")
        self.root, self.info = root, self.get(trailer.get("Info")) or {}

    def get(self, x):
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(int(x))
        return None

    def stream(self, x) -> bytes:
        """Contents of a stream, inflated; all of a file's streams together may not exceed ``MOST_BYTES``."""
        number = int(x)
        head, begin = self.objects.get(number), self.streams.get(number)
        if begin is None:
            return b""
        length = self.get(head.get("Length"))
        end = begin + length if isinstance(length, int) and self.data[begin + length : begin + length + 20].lstrip().startswith(b"endstream") else self.data.find(b"endstream", begin)
        raw = self.data[begin : end if end >= 0 else len(self.data)]
        filters = self.get(head.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if self.get(f) not in ("FlateDecode", "Fl"):
                return b""  # images and the like hold no text
            z = zlib.decompressobj()
            try:
                raw = z.decompress(raw, MOST_BYTES - self.inflated + 1)
            except zlib.error:
                return b""
        self.inflated += len(raw)
        if self.inflated > MOST_BYTES:
            raise UnreadablePdf("the file inflates beyond its limit")
        return raw

    def pages(self) -> Iterator[tuple[int, dict]]:
        """(object number, page with what it inherits), in order."""
        seen: set[int] = set()

        def walk(x, given: dict) -> Iterator[tuple[int, dict]]:
            node = self.get(x)
            if not isinstance(node, dict) or (isinstance(x, Ref) and int(x) in seen):
                return
            if isinstance(x, Ref):
                seen.add(int(x))
            own = {**given, **{k: node[k] for k in ("Resources", "MediaBox") if k in node}}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    yield from walk(kid, own)
            else:
                yield int(x) if isinstance(x, Ref) else -1, {**own, **node}

        yield from walk(self.root.get("Pages"), {})


def text_of(raw: bytes) -> str:
    """A text string of a dictionary."""
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


class Font:
    """Characters and widths of a font's codes."""

    def __init__(self, doc: Document, font: dict) -> None:
        self.wide = font.get("Subtype") == "Type0"
        self.map: dict[int, str] = {}
        self.widths: dict[int, float] = {}
        self.default = 500.0
        encoding = doc.get(font.get("Encoding"))
        base = encoding.get("BaseEncoding") if isinstance(encoding, dict) else encoding
        self.codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
        if isinstance(encoding, dict):
            code = 0
            for x in doc.get(encoding.get("Differences")) or []:
                if isinstance(x, int):
                    code = x
                else:
                    m = re.fullmatch(r"uni([0-9A-F]{4})|(.)", str(x))
                    if m:
                        self.map[code] = chr(int(m.group(1), 16)) if m.group(1) else m.group(2)
                    elif str(x) in _GLYPHS:
                        self.map[code] = _GLYPHS[str(x)]
                    code += 1
        if isinstance(font.get("ToUnicode"), Ref):
            self._unicode(doc.stream(font["ToUnicode"]))
        if self.wide:
            below = doc.get((doc.get(font.get("DescendantFonts")) or [{}])[0]) or {}
            self.default = float(doc.get(below.get("DW")) or 1000)
            rows, k = doc.get(below.get("W")) or [], 0
            while k + 1 < len(rows):
                start, x = rows[k], doc.get(rows[k + 1])
                if isinstance(x, list):
                    self.widths.update({start + n: float(doc.get(v) or 0) for n, v in enumerate(x)})
                    k += 2
                elif k + 2 < len(rows):
                    self.widths.update({c: float(rows[k + 2]) for c in range(start, min(x, start + 65_535) + 1)})
                    k += 3
                else:
                    break
        else:
            start = doc.get(font.get("FirstChar")) or 0
            self.widths = {start + n: float(doc.get(v) or 0) for n, v in enumerate(doc.get(font.get("Widths")) or [])}

    def _unicode(self, cmap: bytes) -> None:
        r, held = Reader(cmap), []
        read = lambda b: b.decode("utf-16-be", "replace") if isinstance(b, bytes) else ""
        while (x := r.next()) is not None:
            if isinstance(x, Keyword):
                if x == "endbfchar":
                    self.map.update({int.from_bytes(a, "big"): read(b) for a, b in zip(held[::2], held[1::2]) if isinstance(a, bytes)})
                elif x == "endbfrange":
                    for a, b, to in zip(held[::3], held[1::3], held[2::3]):
                        first, last = int.from_bytes(a, "big"), min(int.from_bytes(b, "big"), int.from_bytes(a, "big") + 65_535)
                        if isinstance(to, list):
                            self.map.update({first + n: read(t) for n, t in enumerate(to)})
                        else:
                            start = read(to)
                            self.map.update({c: start[:-1] + chr(min(0x10FFFF, ord(start[-1]) + c - first)) for c in range(first, last + 1) if start})
                held = []
            else:
                held.append(x)

    def codes(self, raw: bytes) -> list[int]:
        return [int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw) - 1, 2)] if self.wide else list(raw)

    def char(self, code: int) -> str:
        got = self.map.get(code)
        if got is not None:
            return got
        return "" if self.wide else bytes([code]).decode(self.codec, "replace")


# Glyph names of characters that texts set in simple fonts name most.
_GLYPHS = {"space": " ", "period": ".", "comma": ",", "hyphen": "-", "colon": ":", "semicolon": ";", "quoteright": "’", "quoteleft": "‘", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "parenleft": "(", "parenright": ")", "bullet": "•", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _times(a: list[float], b: list[float]) -> list[float]:
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


def _runs(doc: Document, content: bytes, resources: dict, ctm: list[float], fonts: dict, depth: int = 0) -> Iterator[Run | None]:
    """Runs of a content stream, and None for every image it paints."""
    one = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    state = {"font": None, "size": 1.0, "tc": 0.0, "tw": 0.0, "tz": 1.0, "tl": 0.0, "rise": 0.0}
    saved, tm, line, args = [], one, one, []

    def show(raw: bytes) -> Iterator[Run]:
        nonlocal tm
        font = state["font"]
        if font is None or not isinstance(raw, bytes):
            return
        size, text, width = state["size"], "", 0.0
        for code in font.codes(raw):
            c = font.char(code)
            text += c
            width += (font.widths.get(code, font.default) / 1000 * size + state["tc"] + (state["tw"] if code == 32 and not font.wide else 0)) * state["tz"]
        at = _times([size * state["tz"], 0, 0, size, 0, state["rise"]], _times(tm, ctm))
        whole = _times([width, 0, 0, 0, 0, 0], [*_times(tm, ctm)[:4], 0, 0])
        if text.strip():
            yield Run(text, at[4], at[5], (whole[0] ** 2 + whole[1] ** 2) ** 0.5, (at[2] ** 2 + at[3] ** 2) ** 0.5, at[0], at[1])
        tm = _times([1, 0, 0, 1, width, 0], tm)

    r = Reader(content)
    while (x := r.next()) is not None:
        if not isinstance(x, Keyword):
            args.append(x)
            continue
        n = [a for a in args if isinstance(a, (int, float)) and not isinstance(a, bool)]
        if x == "q":
            saved.append((ctm, dict(state)))
        elif x == "Q" and saved:
            ctm, state = saved.pop()
        elif x == "cm" and len(n) == 6:
            ctm = _times(n, ctm)
        elif x == "BT":
            tm = line = one
        elif x == "Tf" and args and n:
            known = doc.get(doc.get(resources.get("Font") or {}).get(args[0])) if isinstance(doc.get(resources.get("Font")), dict) else None
            if isinstance(known, dict):
                state["font"] = fonts[id(known)] if id(known) in fonts else fonts.setdefault(id(known), Font(doc, known))
            state["size"] = float(n[-1])
        elif x in ("Td", "TD") and len(n) == 2:
            if x == "TD":
                state["tl"] = -n[1]
            tm = line = _times([1, 0, 0, 1, n[0], n[1]], line)
        elif x == "Tm" and len(n) == 6:
            tm = line = [float(v) for v in n]
        elif x == "T*":
            tm = line = _times([1, 0, 0, 1, 0, -state["tl"]], line)
        elif x in ("TL", "Tc", "Tw", "Ts") and n:
            state[{"TL": "tl", "Tc": "tc", "Tw": "tw", "Ts": "rise"}[x]] = float(n[0])
        elif x == "Tz" and n:
            state["tz"] = n[0] / 100
        elif x == "Tj" and args:
            yield from show(args[-1])
        elif x in ("'", '"') and args:
            if x == '"' and len(n) > 1:
                state["tw"], state["tc"] = float(n[0]), float(n[1])
            tm = line = _times([1, 0, 0, 1, 0, -state["tl"]], line)
            yield from show(args[-1])
        elif x == "TJ" and args and isinstance(args[-1], list):
            for part in args[-1]:
                if isinstance(part, bytes):
                    yield from show(part)
                elif isinstance(part, (int, float)):
                    tm = _times([1, 0, 0, 1, -part / 1000 * state["size"] * state["tz"], 0], tm)
        elif x == "Do" and args:
            ref = (doc.get(resources.get("XObject")) or {}).get(args[-1])
            form = doc.get(ref)
            if isinstance(form, dict) and form.get("Subtype") == "Image":
                yield None
            elif isinstance(form, dict) and isinstance(ref, Ref) and depth < 8:
                inner = doc.get(form.get("Resources")) or resources
                yield from _runs(doc, doc.stream(ref), inner, _times([float(v) for v in doc.get(form.get("Matrix")) or one], ctm), fonts, depth + 1)
        elif x == "BI":  # an image in the stream: its bytes are skipped
            end = re.compile(rb"\sEI(?=\s|$)").search(content, r.at)
            r.at = end.end() if end else len(content)
            yield None
        args = []


def read_pdf(content: bytes) -> dict:
    """What ``pdf.pdf_blocks`` needs of a file: title, pages of runs, whether each paints images, size, bookmarks."""
    doc = Document(bytes(content))
    pages, images, numbers, fonts = [], [], {}, {}
    width, height = 612.0, 792.0
    for number, page in doc.pages():
        numbers[number] = len(pages)
        box = [float(doc.get(v) or 0) for v in doc.get(page.get("MediaBox")) or [0, 0, 612, 792]]
        if not pages:
            width, height = box[2] - box[0] or 612.0, box[3] - box[1] or 792.0
        parts = doc.get(page.get("Contents"))
        parts = parts if isinstance(parts, list) else [page.get("Contents")]
        body = b"\n".join(doc.stream(p) for p in parts if isinstance(p, Ref))
        got = list(_runs(doc, body, doc.get(page.get("Resources")) or {}, [1.0, 0.0, 0.0, 1.0, -box[0], -box[1]], fonts))
        pages.append([r for r in got if r is not None])
        images.append(any(r is None for r in got))
    if not pages:
        raise UnreadablePdf("the file has no pages")
    title = doc.get(doc.info.get("Title")) if isinstance(doc.info, dict) else None
    return {"title": text_of(title).strip() if isinstance(title, bytes) else None, "pages": pages, "images": images, "width": width, "height": height, "bookmarks": list(_bookmarks(doc, numbers))}


def _bookmarks(doc: Document, numbers: dict[int, int]) -> Iterator[tuple[str, int | None, int]]:
    seen: set[int] = set()

    def walk(x, depth: int) -> Iterator[tuple[str, int | None, int]]:
        while isinstance(x, Ref) and int(x) not in seen and len(seen) < 100_000:
            seen.add(int(x))
            item = doc.get(x)
            if not isinstance(item, dict):
                return
            to = doc.get(item.get("Dest")) or doc.get((doc.get(item.get("A")) or {}).get("D"))
            title = doc.get(item.get("Title"))
            page = numbers.get(int(to[0])) if isinstance(to, list) and to and isinstance(to[0], Ref) else None
            yield text_of(title) if isinstance(title, bytes) else "", page, depth
            if depth < 32:
                yield from walk(item.get("First"), depth + 1)
            x = item.get("Next")

    outlines = doc.get(doc.root.get("Outlines"))
    if isinstance(outlines, dict):
        yield from walk(outlines.get("First"), 0)
