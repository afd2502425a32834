"""Problem 4: noise in text from scanned pages, by joint word segmentation over de-lined character streams."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.mapped import Mapped, sent
from quire.plans.storage import staged

# What recognition makes of a character (wrong, right); more are learned from the collection.
CONFUSIONS = (("c", "e"), ("1", "i"), ("1", "l"), ("@", "a"), ("ri", "n"), ("0", "o"), ("5", "s"), ("cl", "d"), ("†", "t"), ("ii", "u"), ("rn", "m"), ("li", "h"), ("9", "g"), ("vv", "w"), ("6", "é"), ("6", "ó"), ("f", "e"), ("8", "b"), ("ﬁ", "fi"), ("ﬂ", "fl"))
# Signs that recognition leaves at the end of a word.
STRAYS = "~^■·|"
# What stands for a hyphen at a line end.
HYPHENS = "-‐¬­"

_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_ODD = re.compile(r"(?<!\S)[^\w\s]*((?=\S*[^\W\d_])[\w@†]+(?:['’][\w@†]+)*)[^\w\s]*(?!\S)")
_STRAY = re.compile(r"(?<=[^\W\d_])[~^■·]+(?=[\s.,;:?!]|$)|(?<=[^\W\d_])\|(?=[ \n]|$)|(?<=\w) ,(?=\s\w)")
_SPACED = re.compile(r"(?<!\S)[^\W\d_](?:[ \n][^\W\d_]){2,}(?![^\s.,;:?!])")
_TOKEN = re.compile(rf"([^\w\s†@]*)((?=\S*[^\W\d_])[\w@†]+(?:[{HYPHENS}'’][\w@†]+)*)([^\w\s]*)")
_TOKENS = re.compile(r"\S+")
_GARBLED = re.compile("[ÃГ]\xad|[ÂÃ√]¬")
_HYPHEN = re.compile(rf"\w[{HYPHENS}]\s|\w[‐¬­]\w")
_BREAK = re.compile(rf"([^\W\d_]+)([{HYPHENS}])([ \t]*\n\s*|[ \t]+|(?<=[‐¬­]))([^\W\d_]+)")
_TABLE = re.compile(r"^\s*\|.*\|\s*$|^\s*[-*+]\s|^\s*\d+[.)]\s|^```|^ {4}|^---")
_DIGITS = {"0": "0", "O": "0", "o": "0", "l": "1", "I": "1", "i": "1", "|": "1", "S": "5", "s": "5", "B": "8", "b": "6", "Z": "2", "z": "2", "g": "9", "q": "9"}
#: Bounds of what is looked at: a running line, a word, and the letters of a word that misreadings are learned from.
LINE, WORD, LEARNED = 90, 64, (4, 24)
_N = r"[0-9lIOoSsBbZz|]{1,5}"
_ROMAN = r"(?=[ivxl1I])(?:x{0,3})(?:ix|iv|v?[i1lI]{0,3})"
_NUMBER = re.compile(rf"^\W*(?:(?:p\.|[Pp]age)\s*)?({_N}|{_ROMAN})(?:\s*/\s*\d+)?\W*$")
_BESIDE = re.compile(rf"^(?:(.*\S)\s{{2,}}({_N}|{_ROMAN})|({_N}|{_ROMAN})\s{{2,}}(\S.*))$")
_INLINE = re.compile(rf"(?:(?<=\s)|^)(?:[—–-] ({_N}) [—–-]|\[({_N})\]|(?:p\.|[Pp]age) ({_N})|({_N}) / \d+)(?=\s|$)")


def fold(text: str) -> str:
    """A key that is the same for a line and its misread forms: no case, no blanks, confusable characters alike."""
    key = re.sub(r"[\W_]+", "", text.replace("†", "t").replace("@", "a").lower())
    for wrong, right in (("rn", "m"), ("cl", "d"), ("vv", "w"), ("ri", "n"), ("ii", "u"), ("li", "h"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        key = key.replace(wrong, right)
    return key.translate(str.maketrans("c0159l8f6", "eoisgibee"))


def number_of(token: str) -> int | None:
    """Value of a printed arabic number with misread digits; None if it has no real digit."""
    if not any(c.isdigit() for c in token):
        return None
    digits = "".join(_DIGITS.get(c, c) for c in token)
    return int(digits) if digits.isdigit() else None


def page_number_line(line: str) -> tuple[str, str] | None:
    """(number, rest of the line) if the line is a page number, alone or beside a header."""
    bare = line.strip()
    m = _NUMBER.match(bare)
    if m and m.group(1) and (any(c.isdigit() for c in m.group(1)) or re.fullmatch(_ROMAN, m.group(1))):
        return m.group(1), ""
    m = _BESIDE.match(bare)
    if m:
        number = m.group(2) or m.group(3)
        rest = m.group(1) or m.group(4)
        if any(c.isdigit() for c in number) or re.fullmatch(_ROMAN, number):
            return number, rest
    return None


# Each sign as the least signs it can be read as, by the confusions above.
_SIGNS = {"c": "e", "f": "e", "l": "i", "1": "i", "@": "a", "n": "ri", "0": "o", "5": "s", "d": "ei", "†": "t", "u": "ii", "m": "rri", "h": "ii", "9": "g", "w": "vv", "é": "6", "ó": "6", "8": "b", "ﬁ": "ei", "ﬂ": "ei"}


def shapes_of(learned: Iterable[tuple[str, str]]) -> dict[str, str]:
    """For every sign, what all its readings have in common: confusions leave the shape of a word as it is.

    A learned confusion makes two signs one, or a sign the sum of two; one that fits neither is left out of the shapes, so
    it repairs words that stand by themselves only."""
    out = dict(_SIGNS)

    def put(sign: str, parts: str) -> None:
        for k, v in out.items():
            out[k] = v.replace(sign, parts)
        out[sign] = parts

    for wrong, right in learned:
        a, b = "".join(out.get(c, c) for c in wrong), out.get(right, right)
        if a == b:
            continue
        if len(b) == 1 and b not in a:
            put(b, a)
        elif len(a) == 1 and a not in b:
            put(a, b)
    return out


@dataclass
class Rest:
    """The lexicon's words that are not held in memory: the names they and their shapes are sent under (a word's number
    is twice its count, and one more if it is met on pages only), and the sum of their counts."""

    words: str
    shapes: str | None
    total: int


class _Costs(dict):
    """Costs of the words held, and of the rest as they are asked for."""

    def __init__(self, held: dict[str, float], rest: Rest, total: int) -> None:
        super().__init__(held)
        self.rest, self.total = Mapped(rest.words), total
        self.asked: dict[str, float | None] = {}

    def get(self, word: str, default: float | None = None) -> float | None:
        got = super().get(word)
        if got is None:
            if word not in self.asked:
                if len(self.asked) > 500_000:
                    self.asked.clear()
                n = self.rest.get(word)
                self.asked[word] = None if n is None else log(self.total / (n >> 1))
            got = self.asked[word]
        return default if got is None else got

    def __contains__(self, word: object) -> bool:
        return self.get(word) is not None

    def __missing__(self, word: str) -> float:
        got = self.get(word)
        if got is None:
            raise KeyError(word)
        return got


class Decoder:
    """Word costs from a lexicon, and the best joint segmentation of a short character stream."""

    SPLIT, MERGE, HYPHEN, SWAP, APART = 4.0, 3.0, 1.0, 4.5, 0.5

    def __init__(self, counts: dict[str, int], pruned: bool = False, learned: Iterable[tuple[str, str]] = (), only: frozenset[str] = frozenset(), rest: Rest | None = None) -> None:
        total = max(1, sum(counts.values()) + (rest.total if rest else 0))
        self.cost = {w: log(total / n) for w, n in counts.items()}
        if rest:
            self.cost = _Costs(self.cost, rest, total)
        self.unknown = log(total) + 2.0
        self.memo: dict[str, tuple[float, str, int]] = {}
        self.alike: dict[str, bool] = {}
        self.confusions = (*CONFUSIONS, *(c for c in learned if c not in CONFUSIONS))
        self.shape = str.maketrans(shapes_of(self.confusions[len(CONFUSIONS) :]))
        # the most frequent first, so that what is left does not depend on the order the words came in
        for w in () if pruned else sorted(self.cost, key=lambda w: (-counts[w], w)):
            if self._misread(w, self.cost[w], w in only):
                del self.cost[w]
        self.shapes = sorted({w.translate(self.shape) for w in self.cost})
        self.more = Mapped(rest.shapes) if rest and rest.shapes else None

    def _misread(self, word: str, cost: float, only: bool) -> bool:
        """A word that is a misread form of a far more frequent one is no word of its own; met on pages only, of any one."""
        c, _, swaps = self._swapped(word)
        return swaps > 0 and c - (min(swaps, 2) * self.SWAP if only else 0.0) < cost

    def _prefix(self, shape: str) -> tuple[bool, bool]:
        """Whether a lexicon word, misread or not, begins with the shape, and whether one has just this shape."""
        at = bisect_left(self.shapes, shape)
        there = at < len(self.shapes) and self.shapes[at].startswith(shape)
        same = there and self.shapes[at] == shape
        if same or self.more is None:
            return there, same
        begins, same = self.more.prefix(shape)
        return there or begins, same

    def _swapped(self, word: str) -> tuple[float, str, int]:
        """Least cost of a lexicon word that confusions turn into ``word``: (cost, word, confusions)."""
        best = (float("inf"), word, 0)

        def offer(v: str, swaps: int) -> None:
            nonlocal best
            c = self.cost.get(v)
            if c is not None and c + min(swaps, 2) * self.SWAP < best[0] and len(v) > 1:
                best = (c + min(swaps, 2) * self.SWAP, v, swaps)

        layer = {word}
        for swaps in (1, 2):
            nxt = set()
            for w in layer:
                for wrong, right in self.confusions:
                    at = w.find(wrong)
                    while at >= 0:
                        v = w[:at] + right + w[at + len(wrong) :]
                        offer(v, swaps)
                        nxt.add(v)
                        at = w.find(wrong, at + 1)
            layer = nxt
            if best[2] or len(word) > 24:
                return best
        for wrong, right in self.confusions:  # one confusion in three to six places
            parts = word.split(wrong)
            for n in range(3, len(parts)) if len(parts) <= 7 else ():
                for places in combinations(range(len(parts) - 1), n):
                    offer("".join(x + ("" if k == len(parts) - 1 else right if k in places else wrong) for k, x in enumerate(parts)), n)
        return best

    def word(self, word: str) -> tuple[float, str, int]:
        """(cost, clean word, confusions) of a piece without blanks."""
        got = self.memo.get(word)
        if got is None:
            low = word.lower()
            got = (self.cost[low], word, 0) if low in self.cost else self._swapped(low)
            if got[0] > self.unknown + 2.0 * len(word):
                got = (self.unknown + 2.0 * len(word), word, 0)
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[word] = got
        return got

    def rare(self, text: str) -> list[str]:
        """The text's words that are not held in memory, as far as they look misread."""
        if not isinstance(self.cost, _Costs):
            return []
        out = []
        for w in sorted(set(_WORD.findall(text.lower()))):
            if not dict.__contains__(self.cost, w) and w in self.cost:
                if w not in self.alike:
                    if len(self.alike) > 500_000:
                        self.alike.clear()
                    self.alike[w] = self._swapped(w)[2] > 0
                if self.alike[w]:
                    out.append(w)
        return out

    def _alone(self, token: str) -> float:
        """Cost of a token that is in no lexicon, left as it is; names are in none, so they pay less."""
        return self.unknown + (0.0 if token[:1].isupper() else 4.0)

    def path(self, stream: str) -> tuple[float, list[tuple[int, int, str, int, int, int]]]:
        """Best segmentation of a stream of characters, blanks and hyphens into words.

        Words are (start, end, clean, confusions, blanks dropped inside, hyphens dropped inside).  Blanks between words
        are free, a word boundary without blank costs ``SPLIT``, a blank inside a word ``MERGE`` (less for single letters
        in a row), a hyphen with its line end ``HYPHEN``; a hyphen before a blank may stay for ``APART``.
        """
        n = len(stream)
        best: list = [(0.0, 0, None)] + [None] * n

        def offer(at: int, cost: float, back: int, word: tuple | None) -> None:
            if best[at] is None or cost < best[at][0]:
                best[at] = (cost, back, word)

        for i in range(n):
            if best[i] is None:
                continue
            if stream[i].isspace():
                offer(i + 1, best[i][0], i, None)
                continue
            start = not i or stream[i - 1].isspace()
            if not start and stream[i] == "-" and i + 1 < n and stream[i + 1].isspace():
                offer(i + 1, best[i][0] + self.APART, i, None)
                continue
            base = best[i][0] + (0.0 if start else self.SPLIT)
            piece, kept, blanks, hyphens, j, single, alive = "", "", 0, 0, i, True, True
            while j < n and len(piece) < WORD:
                c = stream[j]
                if c.isspace():
                    blanks += 1
                    single = single and j - i == 2 * len(piece) - 1
                elif c in HYPHENS and piece and j + 1 < n and (stream[j + 1].isspace() or c != "-"):
                    hyphens += 1
                    kept += "-" if c == "-" else ""
                    while j + 1 < n and stream[j + 1].isspace():
                        j += 1
                elif blanks and c.isupper() and not piece.isupper():
                    break
                else:
                    piece += c
                    kept += c
                    low = piece.lower()
                    if alive:
                        alive, word = self._prefix(low.translate(self.shape))
                    else:
                        word = False
                    after = j + 1 == n or stream[j + 1].isspace() or stream[j + 1] in HYPHENS and (stream[j + 1] != "-" or j + 2 == n or stream[j + 2].isspace())
                    extra = base + blanks * (0.5 if single and len(piece) > 2 else self.MERGE) + hyphens * self.HYPHEN
                    if word:
                        cost, clean, swaps = self.word(piece)
                        short = 0.0 if len(piece) > 2 or start and after else self.MERGE  # two letters are easily found in a name
                        offer(j + 1, extra + short + cost, i, (clean, swaps, blanks, hyphens))
                    if after and start and not blanks:
                        offer(j + 1, extra + self._alone(piece) + (4.0 if hyphens else 0.0), i, (piece, 0, 0, hyphens))
                        if hyphens and "-" in kept and kept.lower() in self.cost:
                            offer(j + 1, base + self.cost[kept.lower()], i, (kept, 0, 0, 0))
                    if not alive and (blanks or not start or after and not (j + 1 < n and stream[j + 1] in HYPHENS)):
                        break
                j += 1
        words, at = [], n
        while at:
            _, back, word = best[at]
            if word is not None:
                words.append((back, at, *word))
            at = back
        return best[n][0], words[::-1]

    def decode(self, stream: str) -> tuple[float, list[tuple[str, int, int, int]]]:
        """``path`` without the places."""
        cost, words = self.path(stream)
        return cost, [w[2:] for w in words]

    def broken(self, left: str, hyphen: str, gap: str, right: str) -> bool:
        """Whether a word was split here: decoding heals the hyphen rather than keeping a compound."""
        return right[0].islower() and any(w[3] for w in self.decode(left + hyphen + gap + right)[1])

    def stretches(self, text: str) -> Iterator[tuple[int, list]]:
        """(start, words of the best path) of each maximal run of tokens that are not plain lexicon words, or that a
        hyphen parts, with the tokens beside it.  Table lines keep their hyphens, and so do the remains of wrong
        encodings that look like hyphens."""
        cost = self.cost
        spaced = [m.span() for m in _SPACED.finditer(text)]
        end, tail, before, first, last, odd, at = 0, ".", -1, -1, 0, False, 0
        # a stretch goes from ``first`` to ``last``; ``odd`` tells that its last token is no plain word, ``before`` is
        # where the token before it begins, if nothing but blanks is between
        for m in _TOKENS.finditer(text):
            token, start = m.group(), m.start()
            plain = token.lower() in cost
            if plain:
                lead, w, rest = "", token, ""
            else:
                got = _TOKEN.fullmatch(token)
                lead, w, rest = got.groups() if got else ("", "", ".")
                if w and w.lower() in cost:
                    plain = True
            while at < len(spaced) and spaced[at][1] <= start:
                at += 1
            if at < len(spaced) and spaced[at][0] <= start or not plain and (not w or len(w) > WORD or w[:2].isupper() or "_" in w or ("\xad" in w or "¬" in w) and _GARBLED.search(w)):
                if first >= 0:
                    yield first, self.path(text[first:last])[1]
                before, first, odd, tail, end = -1, -1, False, ".", m.end()
                continue
            begin, stop = start + len(lead), m.end() - len(rest)
            hyphen = bool(tail) and tail in HYPHENS and before >= 0 and w[0].islower() and not lead
            if hyphen:
                hyphen = not (_TABLE.match(_line_at(text, start)) or _TABLE.match(_line_at(text, end - 1)) or _GARBLED.search(text, end - 2, end))
            joins = hyphen or before >= 0 and not tail and not lead and text.count("\n", end, start) < 2
            strange = hyphen or not plain and not ("-" in w and all(x in cost for x in w.lower().split("-")))
            if first >= 0:
                if joins and (odd or strange):
                    last = stop
                else:
                    yield first, self.path(text[first:last])[1]
                    first = -1
            if strange and first < 0:
                first, last = before if joins else begin, stop
            odd, before, tail, end = strange, begin, rest, m.end()
        if first >= 0:
            yield first, self.path(text[first:last])[1]

    def heal(self, text: str) -> tuple[int, str]:
        """How many words are broken in the text, and the text with them healed."""
        edits = []
        for start, words in self.stretches(text) if _HYPHEN.search(text) else ():
            edits += [(start + a, start + b) for a, b, _, _, _, hyphens in words if hyphens]
        for a, b in reversed(edits):
            text = text[:a] + re.sub(rf"[{HYPHENS}]\s+|[‐¬­]", "", text[a:b]) + text[b:]
        return len(edits), text

    def bad_words(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, repaired) of words with misread, stray or spaced-out characters."""
        return [e[:3] for e in self.edits(text) if e[3]]

    def edits(self, text: str, plain: bool = True, own: frozenset[str] = frozenset()) -> list[tuple[int, int, str, bool]]:
        """(start, end, repaired, bad) of all that decoding changes; a blank put between words is no bad word.

        Words in ``own`` are right as they are.  With ``plain``, signs that no word has and letters mixed with digits count
        by themselves, too: they are bad also in names, which no lexicon has."""
        out = [(m.start(), m.end(), "", True) for m in _STRAY.finditer(text) if not ("|" in m.group() and _line_at(text, m.start()).count("|") > 1)] if plain else []
        for m in _SPACED.finditer(text):
            words = self.decode(m.group())[1]
            out.append((m.start(), m.end(), " ".join(w[0] for w in words), True))
        done = set()
        for start, words in self.stretches(text):
            last = -1
            for a, b, clean, swaps, blanks, hyphens in words:
                if a == last and text[start + a - 1] not in HYPHENS:
                    out.append((start + a, start + a, " ", False))
                last = b
                if swaps or blanks:
                    if swaps and not blanks and text[start + a : start + b].lower() in own:
                        continue
                    first = text[start + a]
                    out.append((start + a, start + b, clean[:1].upper() + clean[1:] if first.isupper() else clean, True))
                    done.update(range(start + a, start + b))
        cost = self.cost
        for m in _ODD.finditer(text) if plain else ():
            w = m.group(1)
            if w.lower() in cost or w.lower() in own or not 3 <= len(w) <= WORD or m.start(1) in done:
                continue
            letters = w.isalpha()
            if w.isupper() or w[:2].isupper():
                got = self.word(w)
                if got[2] and letters:
                    out.append((m.start(1), m.end(1), got[1].upper(), True))
                elif not letters and re.search(r"[A-ZÀ-Þ]{2,}[01589@†][A-ZÀ-Þ]*$|^[A-ZÀ-Þ]+[0@†][A-ZÀ-Þ]+", w):
                    out.append((m.start(1), m.end(1), got[1].upper() if got[2] else w, True))
            elif not letters and re.search(r"[^\W\d_][01569@†][^\W\d_]|^[01569@†][^\W\d_]{2,}$|[^\W\d_]{2,}[01569@†]$", w) and "_" not in w:
                out.append((m.start(1), m.end(1), w, True))
        return out


def _without_furniture(text: str) -> str:
    """The text less its page number lines and short lines in capitals, which may stand between a word's halves."""
    if "\n" not in text:
        return text
    return "\n".join(x for x in text.split("\n") if not (x.strip() and len(x) <= LINE and (x.strip().isupper() or page_number_line(x))))


def _line_at(text: str, at: int) -> str:
    end = text.find("\n", at)
    return text[text.rfind("\n", 0, at) + 1 : end if end >= 0 else len(text)]


def paragraphs(lines: list[str]) -> list[list[str]]:
    """Lines put into paragraphs at least cost, by dynamic programming over the last line of each paragraph.

    A paragraph pays for an inner line that is much shorter than the page's lines and ends a sentence, and for a
    last line that does not end a sentence; blank lines always end one.
    """
    if not lines:
        return []
    wide = sorted(len(x) for x in lines)[int(0.9 * (len(lines) - 1))] or 1
    ends = [bool(re.search(r"[.!?…:。！？][\"'”’»)\]]*$", x.strip())) for x in lines]
    stop = [2.0 if e and len(x) < 0.75 * wide else 0.2 if e else 0.0 for e, x in zip(ends, lines)]
    least, back = [0.0] + [float("inf")] * len(lines), [0] * (len(lines) + 1)
    inner = [0.0]
    for s in stop:
        inner.append(inner[-1] + s)
    # cost(i, j) = inner costs of lines i..j-2 + end cost of line j-1; the best start so far is enough for each j
    top, where = 0.0, 0
    for j in range(1, len(lines) + 1):
        end = 0.8 if ends[j - 1] else 2.5
        if not lines[j - 1].strip():
            end = -10.0
        least[j], back[j] = top + inner[j - 1] + end, where
        if least[j] - inner[j] < top:
            top, where = least[j] - inner[j], j
    cuts, at = [], len(lines)
    while at:
        cuts.append((back[at], at))
        at = back[at]
    return [p for a, b in reversed(cuts) if (p := [x for x in lines[a:b] if x.strip()])]


def _facts(model: "Model") -> Callable:
    """Per page record: whether words are broken, how many are bad, printed numbers, and short lines by key."""
    holder: list[Decoder] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holder:
            holder.append(model.decoder())
        d = holder[0]
        for batch in batches:
            hyphen, bad, rare, numbers, keys, texts = [], [], [], [], [], batch.column("text").to_pylist()
            for text, label in zip(texts, batch.column("printed_label").to_pylist()):
                broken, whole = d.heal(_without_furniture(text))
                hyphen.append(broken > 0)
                bad.append(sum(e[3] for e in d.edits(whole)))
                rare.append(d.rare(whole))
                found, lines = [], text.split("\n")
                own, top, end = [], True, len(lines) - 1
                for k, line in enumerate(lines):
                    if not line.strip() or len(line) > LINE or _TABLE.match(line):
                        continue
                    n = page_number_line(line)
                    rest = line
                    if n:
                        found.append(n[0])
                        rest = n[1]
                    if rest.strip() and (n or not re.search(r"[.,;:?!]$", rest.strip())):
                        key = fold(rest)
                        if len(key) >= 4:
                            own.append((key, bool(n) or rest.isupper(), k <= 2 or k >= end - 1, rest.strip()))
                if not found:
                    want = number_of(label) if label else None
                    for m in _INLINE.finditer(text):
                        token = next(g for g in m.groups() if g)
                        if want is not None and number_of(token) == want:
                            found.append(token)
                if len(lines) == 1 or len(lines[0]) > LINE:
                    own.append((fold(lines[0][:LINE])[:64], False, True, ""))
                numbers.append(found)
                keys.append([{"key": a, "marked": b, "edge": c, "line": e} for a, b, c, e in own])
            kind = pa.list_(pa.struct([("key", pa.string()), ("marked", pa.bool_()), ("edge", pa.bool_()), ("line", pa.string())]))
            extra = [pa.array(hyphen), pa.array(bad, pa.int32()), pa.array(rare, pa.list_(pa.string())), pa.array(numbers, pa.list_(pa.string())), pa.array(keys, kind)]
            base = ["id", "document_id", "seq", "page_number", "printed_label"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in base], *extra], [*base, "broken", "bad", "own", "numbers", "lines"])

    return run


_FACTS = "id long, document_id string, seq int, page_number int, printed_label string, broken boolean, bad int, own array<string>, numbers array<string>, lines array<struct<key:string,marked:boolean,edge:boolean,line:string>>"


@dataclass
class Model:
    """What decoding knows of the collection: the most frequent words with their counts (``most_words`` at most, pruned),
    learned confusions, and a table of the rarer words (word, n) with the files they are sent as, or None if there are
    none."""

    counts: dict[str, int]
    learned: list[tuple[str, str]]
    rarer: DataFrame | None = None
    rest: Rest | None = None

    def decoder(self) -> Decoder:
        return Decoder(self.counts, True, self.learned, rest=self.rest)

    def __getstate__(self) -> dict:
        return {"counts": self.counts, "learned": self.learned, "rarer": None, "rest": self.rest}


_LETTERS = "[\\p{L}\\p{M}]+(?:[-'’][\\p{L}\\p{M}]+)*"
_SIGN = "[\\p{L}\\p{M}\\p{N}_@†]"


def _readings(frequent: list[str]) -> Callable:
    """(wrong, right, on, off): by how many words found on pages only, and by how many others, a frequent word would be
    met if ``wrong`` (one or two signs) were read as ``right``."""
    gaps: dict[str, str] = {}
    for w in frequent:
        for k in range(len(w)):
            key = w[:k] + "\0" + w[k + 1 :]
            gaps[key] = gaps.get(key, "") + w[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for w, only in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs = set()
                for k in range(len(w)):
                    for n in (1, 2):
                        for c in gaps.get(w[:k] + "\0" + w[k + n :], "") if k + n <= len(w) else "":
                            pairs.add((w[k : k + n], c))
                for p in pairs:
                    seen.setdefault(p, [0, 0])[0 if only else 1] += 1
        rows = [(a, b, n[0], n[1]) for (a, b), n in seen.items() if a != b]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["wrong", "right", "on", "off"])

    return run


def _readings_joined(strange: DataFrame, frequent: DataFrame) -> DataFrame:
    """What ``_readings`` counts, for more frequent words than a task can hold: words less one or two signs are joined."""

    def gaps(n: int) -> F.Column:
        places = F.sequence(F.lit(1), F.length("w") - n + 1)
        return F.transform(places, lambda k: F.struct(F.concat(F.substring("w", F.lit(1), k - 1), F.lit("\0"), F.substring("w", k + n, F.length("w"))).alias("key"), F.substring("w", k, F.lit(n)).alias("sign")))

    ours = frequent.select(F.explode(gaps(1)).alias("g")).select("g.key", F.col("g.sign").alias("right"))
    theirs = strange.select("w", "only", F.explode(F.concat(gaps(1), gaps(2))).alias("g")).select("w", "only", "g.key", F.col("g.sign").alias("wrong"))
    met = theirs.join(ours, "key").filter("wrong != right").select("w", "only", "wrong", "right").distinct()
    return met.groupBy("wrong", "right").agg(F.count_if("only").alias("on"), F.count_if(~F.col("only")).alias("off"))


class _Ranked:
    """Costs of words as pruning in the order of frequency meets them: of a more frequent word only if it was kept."""

    def __init__(self, counts: dict[str, int], learned: list[tuple[str, str]], raw: Rest, total: int) -> None:
        self.decoder = Decoder(counts, True, learned)
        self.counts, self.raw, self.total = counts, Mapped(raw.words), total
        self.decoder.cost, self.shape = self, self.decoder.shape
        self.at, self.known = (0, ""), {}

    def get(self, word: str) -> float | None:
        n = self.counts.get(word)
        if n is None:
            number = self.raw.get(word)
            if number is None:
                return None
            n = number >> 1
            if (-n, word) < self.at and not self.kept(word, n, bool(number & 1)):
                return None
        return log(self.total / n)

    def kept(self, word: str, n: int, only: bool) -> bool:
        got = self.known.get(word)
        if got is None:
            before, self.at = self.at, (-n, word)
            got = not self.decoder._misread(word, log(self.total / n), only)
            self.at = before
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = got
        return got


def _pruned(counts: dict[str, int], learned: list[tuple[str, str]], raw: Rest, total: int) -> Callable:
    """(w, n, only, shape) of the rarer words that are no misread forms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = _Ranked(counts, learned, raw, total)
        for batch in batches:
            keep = pa.array([ranked.kept(w, n, only) for w, n, only in zip(*(c.to_pylist() for c in batch.columns))], pa.bool_())
            left = batch.filter(keep)
            shapes = pa.array([w.translate(ranked.shape) for w in left.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*left.columns, shapes], ["w", "n", "only", "shape"])

    return run


def learn(chunks: DataFrame, least: int = 3, most_words: int = 500_000, support: int = 12, share: float = 0.04, rare: float = 2e-6, most_frequent: int = 20_000) -> Model:
    """Words and confusions of the collection, from one count of all its words.

    The lexicon holds the words of letters (``WORD`` at most), down to ``least`` occurrences (a share of ``rare`` of all
    words, if they are met on pages only, as torn and misread words are).  Where there are more than ``most_words``, the
    rarer ones are not broadcast but looked up in a sorted file on each executor; the rows are the same.  A confusion is
    learned if it leads from ``support`` words that are met on pages only to a word of 20 occurrences or more, at least
    ``share`` as often as the confusion that does so most, and ten times as often as from words met elsewhere.  Where
    there are more than ``most_frequent`` such words, a join counts what it leads to; the counts are the same.
    """
    token = f"{_SIGN}+(?:[-'’]{_SIGN}+)*"
    words = chunks.filter("text is not null").select(F.col("page_number").isNotNull().cast("int").alias("p"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(token), F.lit(0))).alias("w"))
    words = staged(words.groupBy("w").agg(F.count("*").alias("n"), F.sum("p").alias("p")), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = (F.col("n") >= least) & ((F.col("p") < F.col("n")) | (F.col("n") >= F.lit(rare * total)))
    plain = words.filter(met & (F.length("w") <= WORD) & F.col("w").rlike(f"^{_LETTERS}$"))
    bins = plain.groupBy(F.floor(F.log2("n") * 8).alias("b")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect()  # 512 rows at most
    cut, held = 1 << 62, 0
    for r in sorted(bins, key=lambda r: -r.b):
        held += r.k
        if held > most_words:
            break
        cut = r.n
    kept = plain.filter(F.col("n") >= cut).collect()
    counts, only = {r.w: r.n for r in kept}, frozenset(r.w for r in kept if r.p == r.n)
    often = plain.filter((F.col("n") >= 20) & F.length("w").between(*LEARNED)).select("w")
    frequent = [r.w for r in often.limit(most_frequent + 1).collect()]
    strange = words.filter((F.length("w").between(*LEARNED)) & F.col("w").rlike("\\p{L}") & (F.col("n") < 20)).select("w", (F.col("p") == F.col("n")).alias("only"))
    if len(frequent) > most_frequent:
        seen = _readings_joined(strange, often)
    else:
        seen = strange.mapInArrow(_readings(frequent), "wrong string, right string, on long, off long").groupBy("wrong", "right").agg(F.sum("on").alias("on"), F.sum("off").alias("off"))
    seen = staged(seen.filter((F.col("on") >= support) & (F.col("on") >= 10 * F.col("off"))), "confusions")
    best = seen.join(F.broadcast(seen.agg(F.max("on").alias("top"))), F.col("on") >= share * F.col("top")).orderBy(F.desc("on"), "wrong", "right").collect()
    learned = [(r.wrong, r.right) for r in best]  # 25 or so: signs, whatever the collection
    if held <= most_words:
        words_ = Decoder(counts, learned=learned, only=only).cost  # pruned here once, not in every task
        return Model({w: n for w, n in counts.items() if w in words_}, learned)
    rarer = plain.filter(F.col("n") < cut).select("w", "n", (F.col("p") == F.col("n")).alias("only"))
    number = F.col("n") * 2 + F.col("only").cast("int")
    raw = Rest(sent(rarer.select("w", number), "raw"), None, rarer.agg(F.sum("n")).first()[0])
    every = sum(counts.values()) + raw.total
    words_ = Decoder(counts, learned=learned, only=only, rest=raw).cost
    counts = {w: n for w, n in counts.items() if w in words_}
    rarer = staged(rarer.mapInArrow(_pruned(counts, learned, raw, every), "w string, n long, only boolean, shape string"), "rarer")
    left = rarer.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rest = Rest(sent(rarer.select("w", number), "rarer"), sent(rarer.select("shape", F.lit(0)).distinct(), "shapes"), left)
    return Model(counts, learned, rarer.select("w", "n"), rest)


def _titles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fold(t or "") for t in batch.column(1).to_pylist()], pa.string())], ["document_id", "title_key"])


def _roman(n: F.Column) -> F.Column:
    """Lower-case roman numeral of 1 to 4,999."""
    out = F.repeat(F.lit("m"), F.floor(n / 1000).cast("int"))
    for unit, (one, five, ten) in ((100, ("c", "d", "m")), (10, ("x", "l", "c")), (1, ("i", "v", "x"))):
        digit = F.floor(n / unit) % 10
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        out = F.concat(out, F.element_at(F.array(*[F.lit(x) for x in forms]), (digit + 1).cast("int")))
    return out


def _hot(facts: DataFrame, hot_rows: int) -> DataFrame | None:
    """(document_id, salts) of documents with more than ``hot_rows`` pages (so at most pages / ``hot_rows`` of them, which
    are broadcast); None if there is none."""
    n = facts.groupBy("document_id").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows)
    rows = n.select("document_id", F.ceil(F.col("n") / hot_rows).cast("int").alias("salts")).collect()
    return facts.sparkSession.createDataFrame(rows, "document_id string, salts int") if rows else None


def _by_document(rows: DataFrame, facts: DataFrame, on: list[str], how: str, hot: DataFrame | None) -> DataFrame:
    """Join of page rows with a table that has one row for each ``on``; the pages of hot documents are spread."""
    if hot is None:
        return rows.join(facts, on, how)
    salts = F.coalesce("salts", F.lit(1))
    left = rows.join(F.broadcast(hot), "document_id", "left").withColumn("_salt", F.pmod(F.xxhash64("id"), salts).cast("int")).drop("salts")
    right = facts.join(F.broadcast(hot), "document_id", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def page_facts(chunks: DataFrame, documents: DataFrame, model: Model | None = None, hot_rows: int = 100_000) -> DataFrame:
    """One row per page record: id, noise (array of kinds), headers (keys of running lines), right_label, own (words that
    look misread and are not)."""
    model = model or learn(chunks)
    pages = chunks.filter("text is not null and page_number is not null and document_id is not null").select("id", "document_id", "seq", "page_number", "printed_label", "text")
    facts = staged(pages.mapInArrow(_facts(model), _FACTS), "pages")
    hot = _hot(facts, hot_rows)
    titles = documents.filter("document_id is not null").select("document_id", "title").mapInArrow(_titles, "document_id string, title_key string").groupBy("document_id").agg(F.max("title_key").alias("title_key"))
    lines = facts.select("id", "document_id", "seq", "page_number", F.explode("lines").alias("l")).select("id", "document_id", "seq", "page_number", "l.*")
    lines = _by_document(lines, titles, ["document_id"], "left", hot)
    is_title = (F.length("title_key") >= 4) & ((F.col("key") == F.col("title_key")) | ((F.col("line") == "") & F.col("key").startswith(F.substring("title_key", 1, 40))))
    per = lines.withColumn("titled", F.coalesce(is_title, F.lit(False))).withColumn("key", F.when(F.col("titled"), F.lit("")).otherwise(F.col("key"))).filter(F.col("titled") | ((F.col("line") != "") & (F.col("edge") | F.col("marked"))))
    per = per.groupBy("id", "document_id", "seq", "page_number", "key").agg(F.count("*").alias("times"), F.max("marked").alias("marked"), F.max("titled").alias("titled"))
    # the title above the first page's text is no header; a second one there is
    per = per.filter(~(F.col("titled") & (F.col("seq") == 0) & (F.col("times") == 1) & ~F.col("marked")))
    on = per.groupBy("document_id", "key").agg(F.countDistinct("page_number").alias("n")).filter("n >= 2").select("document_id", "key")
    headers = _by_document(per, on, ["document_id", "key"], "inner", hot).groupBy("id").agg(F.collect_set("key").alias("headers"))
    # the document's numbering: the offset most labels and printed numbers agree on, after roman front matter
    digits = "^[0-9]{1,6}$"
    said = facts.filter(F.col("printed_label").isNotNull())
    voted = facts.select("document_id", "page_number", F.explode(F.array_distinct(F.concat(F.col("numbers"), F.array("printed_label")))).alias("v"))
    votes = voted.filter(F.col("v").rlike(digits)).select("document_id", (F.col("v").cast("int") - F.col("page_number")).alias("offset"), "page_number")
    offset = votes.groupBy("document_id", "offset").agg(F.count("*").alias("n"), F.min("page_number").alias("first"))
    offset = offset.groupBy("document_id").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "offset")).alias("o")).select("document_id", F.col("o.offset").alias("offset"), (-F.col("o.f")).alias("arabic_from"))
    roman = voted.filter(F.col("v").rlike("^[ivxlcdm]+$") & (F.col("v") == _roman(F.col("page_number")))).groupBy("document_id").agg(F.max("page_number").alias("roman_to"))
    numbering = offset.join(roman, "document_id", "full")
    label = _by_document(said.select("id", "document_id", "page_number", "printed_label"), numbering, ["document_id"], "left", hot)
    front = (F.col("page_number") <= F.coalesce("roman_to", F.lit(0))) | (F.col("roman_to").isNotNull() & (F.col("page_number") < F.coalesce("arabic_from", F.lit(1 << 30))) & ~F.col("printed_label").rlike("[02-9]"))
    want = F.when(front, _roman(F.col("page_number"))).otherwise(F.when(F.col("offset").isNotNull(), (F.col("page_number") + F.col("offset")).cast("string")))
    label = label.select("id", want.alias("right_label")).dropDuplicates(["id"])
    out = facts.join(headers, "id", "left").join(label, "id", "left")
    kinds = F.array(
        F.when(F.col("broken"), F.lit("hyphen")),
        F.when(F.col("bad") >= 2, F.lit("chars")),
        F.when(F.col("headers").isNotNull(), F.lit("header")),
        F.when(F.size("numbers") > 0, F.lit("page_number")),
        F.when(F.col("printed_label").isNotNull() & (F.col("printed_label") != F.coalesce("right_label", "printed_label")), F.lit("label")),
    )
    return out.select("id", F.filter(kinds, lambda k: k.isNotNull()).alias("noise"), F.coalesce("headers", F.array().cast("array<string>")).alias("headers"), F.coalesce("right_label", "printed_label").alias("right_label"), "document_id", "own")


def page_noise(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, noise): one row per page record and kind of noise.

    Kinds: hyphen, chars (two words or more), header, page_number, label.  Records without a page number, with null
    text or null document_id have no row; repeated rows are one case.  A running line has ``LINE`` characters at most, a
    word ``WORD``; roman numbers go up to 4,999.
    """
    return page_facts(chunks, documents).select("id", F.explode("noise").alias("noise")).distinct()


def repaired_pages(chunks: DataFrame, documents: DataFrame, plain: bool = True) -> DataFrame:
    """(id, label, n_paragraphs, broken, bad, text): every page record's continuous paragraphs and its right label.

    Running headers and page numbers are dropped, words broken at line ends healed, misread words replaced by what
    decoding found, and lines joined into paragraphs.  Tables, lists and code keep their lines.  ``broken`` and ``bad``
    count the words healed and repaired.  Without ``plain`` only what decoding finds is changed and counted.
    """
    model = learn(chunks)
    facts = staged(page_facts(chunks, documents, model).dropDuplicates(["id"]), "facts")
    titles = documents.filter("document_id is not null").select("document_id", "title").mapInArrow(_titles, "document_id string, title_key string").groupBy("document_id").agg(F.max("title_key").alias("title_key"))
    rows = chunks.filter("text is not null and page_number is not null").select("id", "text").join(_by_document(facts, titles, ["document_id"], "left", _hot(facts, 100_000)).drop("document_id"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = model.decoder()
        for batch in batches:
            texts, sizes, broken, bad = [], [], [], []
            for r in batch.select(["text", "headers", "title_key", "own"]).to_pylist():
                drop = {r["title_key"] if k == "" else k for k in r["headers"]}
                out, healed, mended = _repair(d, r["text"], drop, plain, frozenset(r["own"]))
                texts.append("\n\n".join(out))
                sizes.append(len(out))
                broken.append(healed)
                bad.append(mended)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("right_label"), pa.array(sizes, pa.int32()), pa.array(broken, pa.int32()), pa.array(bad, pa.int32()), pa.array(texts, pa.string())], ["id", "label", "n_paragraphs", "broken", "bad", "text"])

    return rows.mapInArrow(run, "id long, label string, n_paragraphs int, broken int, bad int, text string")


def repair(d: Decoder, text: str, headers: set[str]) -> list[str]:
    """Paragraphs of a page's text; ``headers`` are keys of lines to drop."""
    return _repair(d, text, headers)[0]


def _repair(d: Decoder, text: str, headers: set[str], plain: bool = True, own: frozenset[str] = frozenset()) -> tuple[list[str], int, int]:
    """Paragraphs of a page's text, and how many words were healed and repaired."""
    kept = []
    for line in text.split("\n"):
        n = page_number_line(line) if line.strip() else None
        rest = n[1] if n else line
        if n and not rest.strip() or rest.strip() and len(rest) <= LINE and fold(rest) in headers:
            continue
        kept.append(rest)
    text = "\n".join(kept)
    healed, text = d.heal(text)
    changes = d.edits(text, plain, own)
    for a, b, new, _ in sorted(changes, reverse=True):
        text = text[:a] + new + text[b:]
    out: list[str] = []
    prose: list[str] = []
    for line in [*text.split("\n"), None]:
        if line is None or _TABLE.match(line):
            out += [" ".join(x.strip() for x in p) for p in paragraphs(prose)]
            prose = []
            if line is not None:
                if out and _TABLE.match(out[-1].split("\n")[-1]):
                    out[-1] += "\n" + line
                else:
                    out.append(line)
        else:
            prose.append(line)
    return out, healed, sum(e[3] for e in changes)
