"""Problem 10: language of documents and of stretches within them, by hyperdimensional n-gram profiles."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and codes by which a label can spell a language.
SPELLINGS = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français",
    "es": "es spa spanish español castilian",
    "pt": "pt por portuguese português",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands",
    "sv": "sv swe swedish svenska",
    "pl": "pl pol polish polski",
    "ru": "ru rus russian русский",
    "ja": "ja jpn japanese 日本語",
}
# Labels that say the language is not known.
UNKNOWN = ("", "und", "n/a", "na", "unknown", "none", "null", "nil", "mul", "mis", "zxx", "xx", "?", "-", "other", "undetermined")

_ENDS = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])|\n\s*\n\s*|\n(?=\s*(?:[-*+•|#]\s|\d+[.)]\s))")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def label_code(label: Column) -> Column:
    """Two-letter code a label stands for; null for a missing or unknown label, the label itself if it is none of ours."""
    plain = F.lower(F.trim(F.regexp_replace(label, "[\\s\\u00a0]+", " ")))
    base = F.regexp_extract(plain, "^([^-_]*)", 1)
    base = F.when(plain.isin(*UNKNOWN) | base.isin(*UNKNOWN), F.lit(None)).otherwise(base)
    out = None
    for code, names in SPELLINGS.items():
        hit = base.isin(*names.split())
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(base)


class Profiles:
    """Language prototypes in a space of ``dim`` dimensions.

    Every letter has a random vector of +-1; an n-gram's vector is the product of its letters' vectors, each
    permuted (rolled) by its place; a text's vector is the sum of its n-grams' vectors.  An n-gram has three letters,
    one where that is Japanese: samples hold few of the many triples, and the letters themselves tell.  As the comparison with a
    prototype is linear in the trigrams, the products of a trigram with all prototypes are computed once, when it
    is first met, and kept in a two-way hash table of fixed size.
    """

    SLOTS = 1 << 19

    def __init__(self, samples: list[tuple[str, str]], dim: int = 2048, seed: int = 11) -> None:
        self.dim, self.seed, self.token = dim, seed, uuid.uuid4().hex
        self.langs = sorted({lang for lang, _ in samples})
        self.letters: dict[int, np.ndarray] = {}
        protos = np.zeros((len(self.langs), dim), dtype=np.float64)
        for k, lang in enumerate(self.langs):
            codes = [self.trigrams(t)[0] for of, t in samples if of == lang]
            keys, n = np.unique(np.concatenate(codes), return_counts=True)
            for at in range(0, len(keys), 4096):
                protos[k] += n[at : at + 4096] @ self.encode(keys[at : at + 4096]).astype(np.float64)
        self.protos = (protos / np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.full(self.SLOTS, -1, dtype=np.int64)
        self.products = np.zeros((self.SLOTS, len(self.langs)), dtype=np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("keys", "products", "letters")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.letters, self.keys = {}, None

    def letter(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            v = self.letters[code] = np.ones(self.dim, dtype=np.int8) if code == 0 else np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1
        return v

    def encode(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of trigrams."""
        parts = []
        for shift, roll in ((42, 2), (21, 1), (0, 0)):
            code = (keys >> shift) & 0x1FFFFF
            uniq, back = np.unique(code, return_inverse=True)
            parts.append(np.stack([np.roll(self.letter(int(c)), roll) for c in uniq])[back])
        return parts[0] * parts[1] * parts[2]

    @staticmethod
    def _keys(c: np.ndarray) -> np.ndarray:
        """Keys of the n-grams that begin at each place but the last two: three letters, one in Japanese script."""
        japanese = (((c >= 0x3040) & (c <= 0x30FF)) | ((c >= 0x3400) & (c <= 0x9FFF)))[:-2]
        return (c[:-2] << 42) | np.where(japanese, 0, (c[1:-1] << 21) | c[2:])

    @classmethod
    def trigrams(cls, text: str) -> tuple[np.ndarray, int]:
        plain = " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "
        c = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        if len(c) < 3:
            return np.zeros(0, dtype=np.int64), 0
        return cls._keys(c), len(c) - 2

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = keys.astype(np.uint64)
        return ((u * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64), ((u * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(45)).astype(np.int64)

    def scores(self, keys: np.ndarray) -> np.ndarray:
        """Product of each trigram's vector with each prototype."""
        if self.keys is None:
            self._clear()
        one, two = self._slots(keys)
        slot = np.where(self.keys[one] == keys, one, two)
        bad = self.keys[slot] != keys
        if not bad.any():
            return self.products[slot]
        fresh = np.unique(keys[bad])
        vals = np.concatenate([self.encode(fresh[a : a + 2048]).astype(np.float32) @ self.protos.T for a in range(0, len(fresh), 2048)])
        f1, f2 = self._slots(fresh)
        for k, a, b, v in zip(fresh.tolist(), f1.tolist(), f2.tolist(), vals):
            s = a if self.keys[a] < 0 else b if self.keys[b] < 0 else -1
            if s >= 0:
                self.keys[s], self.products[s] = k, v
        out = self.products[slot]
        out[bad] = vals[np.searchsorted(fresh, keys[bad])]
        return out

    def cosines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cosine of every text with every prototype, and its number of trigrams.

        Vectors of different trigrams are nearly orthogonal, so the length of a bundle is that of its counts: the square
        root of dim times the sum of their squares.
        """
        plain = [" " + _NOT_LETTERS.sub(" ", t.lower()).strip() + "  " for t in texts]
        c = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        ends = np.cumsum([len(p) for p in plain])
        n = np.diff(np.concatenate([[0], ends])) - 3  # the last blank of each keeps texts apart
        sums, squares = np.zeros((len(texts), len(self.langs))), np.ones(len(texts))
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + 1_000_000)))
            a, b = int(ends[first - 1]) if first else 0, int(ends[last - 1])
            part = c[a:b]
            keys = self._keys(part)
            squares[first:last] = self._squares(keys, ends[first:last] - a)
            s = self.scores(keys)
            s = np.concatenate([s, np.zeros((2, s.shape[1]), s.dtype)])
            at = np.concatenate([[0], ends[first : last - 1] - a]).astype(np.int64)
            edge = np.concatenate([at[1:], [b - a]])
            s[edge - 1] = 0  # trigrams that reach over the end of a text
            s[edge - 2] = 0
            sums[first:last] = np.add.reduceat(s, at, axis=0)
            first = last
        return sums / np.sqrt(squares * float(self.dim))[:, None], n

    @staticmethod
    def _squares(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sum of the squared counts of each text's trigrams; ``ends`` are where the texts end."""
        of = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))[: len(keys)]
        own = np.arange(len(keys)) < ends[of] - 2  # not those that reach into the next text
        # equal (text, trigram) pairs have equal sums of hashes, and others do not but by a chance of 2**-40 or so
        mixed = np.sort((keys[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) + (of[own].astype(np.uint64) << np.uint64(40)))
        new = np.concatenate([[True], np.diff(mixed) != 0]) if len(mixed) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        times = np.diff(np.concatenate([at, [len(mixed)]])).astype(float)
        return np.maximum(1.0, np.bincount((mixed[at] >> np.uint64(40)).astype(np.int64), weights=times**2, minlength=len(ends)))


def _sentences(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in _ENDS.finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


_LIVE: dict[str, Profiles] = {}


def _live(profiles: Profiles) -> Profiles:
    """The copy of the profiles that this Python worker already has, with what it has computed."""
    if profiles.token not in _LIVE:
        _LIVE.clear()
        _LIVE[profiles.token] = profiles
    return _LIVE[profiles.token]


_MARKED = re.compile(r"\A---[ \t]*\r?\n.*?\n---[ \t]*(?:\r?\n|\Z)|^[ \t]*```.*?(?:^[ \t]*```[ \t]*$|\Z)", re.S | re.M)
_CLOSED = re.compile(r"[.!?…。！？][\"'”’»)\]]*\s*$")
_TABULAR = re.compile(r"\s*(?:\||#{1,6}\s)")


def _prose(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which pieces are sentences: not front matter, code, table rows, headings or short lines without an end."""
    marked = [m.span() for m in _MARKED.finditer(text)] if "---" in text[:8] or "```" in text else ()
    out = np.ones(len(spans), dtype=bool)
    for k, (a, b) in enumerate(spans):
        piece = text[a:b]
        if _TABULAR.match(piece) or (not _CLOSED.search(piece) and piece.count(" ") < 6) or any(a < hi and b > lo for lo, hi in marked):
            out[k] = False
    return out


def _states(cos: np.ndarray, n: np.ndarray, prose: np.ndarray, switch: float) -> np.ndarray:
    """Language of every piece: the best path, where a change of language costs ``switch`` and only prose has a say."""
    emit = cos * (prose * np.minimum(1.0, n / 24.0))[:, None]
    best, back = emit[0].copy(), []
    for e in emit[1:]:
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, best[top] - switch) + e
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def _identify(profiles: Profiles, switch: float, weak: float):
    names = profiles.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = _live(profiles)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            spans = [_sentences(t) for t in texts]
            flat = [t[a:b] for t, sp in zip(texts, spans) for a, b in sp]
            cos, n = mine.cosines(flat) if flat else (np.zeros((0, len(names))), np.zeros(0))
            top = cos.argmax(1) if len(cos) else np.zeros(0, int)
            rows, at = [], 0
            for text, sp in zip(texts, spans):
                k = len(sp)
                c, m, t = cos[at : at + k], n[at : at + k], top[at : at + k]
                at += k
                if not k or not (m > 0).any():
                    rows.append((None, 0.0, []))
                    continue
                prose = _prose(text, sp) & (m >= 8) & (c[np.arange(k), t] >= weak)
                if not prose.any():
                    prose = m > 0
                real, first = prose, t[prose][0]
                state = np.full(k, first) if (t[prose] == first).all() else _states(c, m, prose, switch)
                m = np.where(prose, m, 0)
                cuts = np.flatnonzero(np.diff(state)) + 1
                segments, weight = [], {}
                for a, b in zip([0, *cuts], [*cuts, k]):
                    lang = int(state[a])
                    mean = c[a:b].T @ m[a:b] / max(m[a:b].sum(), 1)
                    rest = np.delete(mean, lang).max() if len(names) > 1 else 0.0
                    sure = float(np.clip((mean[lang] - rest) / max(mean[lang], 1e-6), 0, 1))
                    weight[lang] = weight.get(lang, 0) + int(real[a:b].sum()) + int(m[a:b].sum()) * 1e-6
                    segments.append({"start": sp[a][0], "end": sp[b - 1][1], "lang": names[lang], "confidence": round(sure, 4), "sentences": int(real[a:b].sum())})
                main = max(weight, key=lambda x: (weight[x], -x))
                sure = sum(s["confidence"] * (s["end"] - s["start"]) for s in segments if s["lang"] == names[main]) / sum(s["end"] - s["start"] for s in segments if s["lang"] == names[main])
                rows.append((names[main], round(sure * weight[main] / sum(weight.values()), 4), segments))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], kind)], ["doc_id", "main", "confidence", "segments"])

    return run


def identify_languages(documents: DataFrame, samples: DataFrame, switch: float = 0.10, weak: float = 0.1, dim: int = 2048, max_samples: int = 20_000) -> DataFrame:
    """Language of every document and of every stretch of it.

    The prototypes are bundled from labelled ``samples`` (lang, text), at most ``max_samples`` of them (more raise
    an error).  Every sentence is compared with the prototypes by cosine; the languages of a document's sentences
    are its best path under a cost of ``switch`` for each change.  Front matter, code, table rows, headings and
    pieces less like any prototype than ``weak`` have no say unless there is nothing else, and count as no sentences.
    The stored ``lang`` is not used to decide.

    Result: doc_id, label (two-letter code of the stored lang, null if it names none), main (language of most
    sentences, then letters), confidence (0 to 1), segments (start, end, lang, confidence, sentences).  Null, empty and letterless
    texts get a null main and no segments.
    """
    rows = samples.filter("lang is not null and text is not null").select("lang", "text").limit(max_samples + 1).collect()
    if len(rows) > max_samples:
        raise ValueError("more samples than max_samples")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), label_code(F.col("lang")).alias("label"))
    schema = "doc_id long, main string, confidence double, segments array<struct<start:int,end:int,lang:string,confidence:double,sentences:int>>"
    if not rows:
        return docs.select("doc_id", "label", F.lit(None).cast("string").alias("main"), F.lit(0.0).alias("confidence"), F.from_json(F.lit("[]"), schema.split("segments ")[1]).alias("segments"))
    profiles = Profiles(sorted((r.lang, r.text) for r in rows), dim)
    run = _identify(profiles, switch, weak)

    def with_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in run(iter([batch])):
                yield pa.RecordBatch.from_arrays([out.column(0), batch.column(2), *out.columns[1:]], ["doc_id", "label", *out.schema.names[1:]])

    return docs.mapInArrow(with_label, schema.replace("doc_id long,", "doc_id long, label string,"))


def language_cases(identified: DataFrame, in_a_row: int = 3) -> DataFrame:
    """(doc_id, lang): documents whose label is missing or wrong or whose text mixes languages.

    One row per language that fills ``in_a_row`` sentences in a row; a document in which none does has its main
    language.  Documents without letters are no case.
    """
    long = F.array_distinct(F.transform(F.filter("segments", lambda s: s["sentences"] >= in_a_row), lambda s: s["lang"]))
    langs = F.when(F.size(long) == 0, F.array("main")).otherwise(long)
    cases = identified.filter(F.col("main").isNotNull()).withColumn("langs", langs)
    cases = cases.filter(F.col("label").isNull() | (F.col("label") != F.col("main")) | (F.size("langs") > 1))
    return cases.select("doc_id", F.explode("langs").alias("lang")).distinct()
