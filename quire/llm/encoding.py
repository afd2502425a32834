"""Problem 2: text that was decoded with a wrong character encoding."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import log1p

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.storage import staged

# The encodings that are taken into account, by Python's names.
SINGLE = ("cp1252", "cp1250", "iso8859_2", "cp1251", "koi8_r", "iso8859_5", "mac_roman", "mac_cyrillic", "cp437", "cp850", "cp852", "cp866")
WRONG = (*SINGLE, "latin_1")
MULTI = ("utf_8", "shift_jis", "euc_jp")
CYRILLIC = ("cp1251", "koi8_r", "iso8859_5", "mac_cyrillic", "cp866")

#: Words: runs of ASCII letters and of characters beyond ASCII, but for the scripts written without blanks.
WORD = "[A-Za-z\\x{80}-\\x{2FFF}\\x{A000}-\\x{ABFF}\\x{E000}-\\x{FEFF}]+"
_WORD = re.compile("[A-Za-z\u0080-⿿ꀀ-꯿-﻿]+")
_RUN = re.compile("[^\x00-\x7f]+")
_DAMAGED = re.compile("[A-Za-z]*+[\u0080-\u2fff\ua000-\uabff\ue000-\ufeff][A-Za-z\u0080-\u2fff\ua000-\uabff\ue000-\ufeff]*")
_BROKEN = re.compile("[\x80-\x84\x86-\x9f\ufffd]")
#: A lost character, or a control character that only a wrong decoding leaves behind.
LOST = "\\x{FFFD}"
_C1 = re.compile("[\x80-\x9f]")
CONTROL = "[\\x{80}-\\x{84}\\x{86}-\\x{9F}]"


def _table(codec: str) -> dict[str, int]:
    """Byte of each character; bytes a codec leaves undefined stand for themselves, as lenient decoders do."""
    out: dict[str, int] = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


_BYTES = {c: _table(c) for c in WRONG}
_CHARS = {c: {b: ch for ch, b in t.items()} for c, t in _BYTES.items()}
_TRAIL = "[" + "".join(f"\\x{{{ord(_CHARS['cp1252'][b]):X}}}" for b in range(0x80, 0xC0)) + "]"
#: Four bytes of UTF-8 read as cp1252.
_ASTRAL = "\\x{F0}[" + "".join(f"\\x{{{ord(_CHARS['cp1252'][b]):X}}}" for b in range(0x90, 0xC0)) + "]" + _TRAIL + "{2}"
#: Transformations (true, wrong): text was written in ``true`` and read as ``wrong``.
STEPS = [(t, w) for t in (*MULTI, *SINGLE) for w in WRONG if t != w]


def applies(text: str, step: tuple[str, str]) -> bool:
    """Latin-1 reads as cp1252 does but for the control characters, so only those tell of it."""
    return step[1] != "latin_1" or _C1.search(text) is not None


def undo(run: str, step: tuple[str, str]) -> str | None:
    """The run of non-ASCII characters as it was before ``step``; None if the step cannot have made it."""
    true, wrong = step
    table = _BYTES[wrong]
    try:
        raw = bytes(table[c] for c in run)
    except KeyError:
        return None
    if true in _CHARS:
        back = "".join(_CHARS[true].get(b, "\x80") for b in raw)
        return None if any(c < "\xa0" for c in back) else back
    try:
        back = raw.decode(true)
    except UnicodeDecodeError:
        return None
    return None if any(c < "\xa0" for c in back) else back


def strict(run: str, back: str, step: tuple[str, str]) -> str:
    """The characters of ``back`` that the run does not prove by itself.

    Three or four bytes that decode as UTF-8 prove their character, but for runs of letters only: Cyrillic and Central
    European words can be such bytes in some codecs ("сад" in cp866, "ášť" in cp1250).
    """
    if step[0] != "utf_8" or step[1] not in ("cp1252", "latin_1") and all(c.isalpha() for c in run):
        return back
    return "".join(c for c in back if c < "\u0800")


def undo_word(word: str, step: tuple[str, str], alphabet: frozenset[str] | None) -> str | None:
    """The word with every run undone, again and again while the step still applies (text may be garbled twice).

    Single-byte steps keep the runs that they leave as they are; multi-byte steps need every run to decode into
    characters of ``alphabet``, or into such as UTF-8 proves by itself (see ``strict``).
    """
    multi = step[0] in MULTI
    proven: set[str] = set()

    def once(text: str) -> str | None:
        parts, at, changed = [], 0, False
        for m in _RUN.finditer(text):
            back = undo(m.group(), step)
            if back is None:
                if multi:
                    return None
                back = m.group()
            elif multi:
                proven.update(set(back) - set(strict(m.group(), back, step)))
            parts += [text[at : m.start()], back]
            changed |= back != m.group()
            at = m.end()
        return "".join([*parts, text[at:]]) if changed else None

    best = None
    for _ in range(3):
        word = once(word)
        if word is None:
            break
        if alphabet is None or all(c < "\x80" or c in alphabet or c in proven for c in word):
            best = word
        if not multi:
            break
    return best


def align(garbled: str, clean: str) -> list[tuple[str, str]]:
    """Runs of non-ASCII characters that stand between the same ASCII characters of two words."""
    if _RUN.sub("", garbled) != _RUN.sub("", clean):
        return []
    cut = re.compile("([\x00-\x7f])")
    g, c = cut.split(garbled), cut.split(clean)
    if len(g) != len(c):
        return []
    return [(x, y) for x, y in zip(g, c) if x != y and x and y]


def explains(run: str, clean: str) -> list[int]:
    """Places in ``STEPS`` of the steps that make ``run`` of ``clean``, once or (several bytes a character) twice."""
    out = []
    for k, step in enumerate(STEPS):
        if applies(run, step):
            back = undo(run, step)
            if back == clean or back and back != run and step[0] in MULTI and undo(back, step) == clean:
                out.append(k)
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(garbled, clean, steps, n): runs that stand for each other in twins, with the steps that explain them."""
    for batch in batches:
        found: Counter = Counter()
        for g, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found.update(align(g, c))
        rows = list(found.items())
        yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], pa.string()), pa.array([r[0][1] for r in rows], pa.string()), pa.array([explains(*r[0]) for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.int64())], ["garbled", "clean", "steps", "n"])


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the one scan of the texts keeps of each with characters beyond ASCII: its words that hold such, in order,
    the hash of what stripping leaves and of the text, its characters, and whether some are lost or none of any text."""
    for batch in batches:
        keep, words, bare, whole, chars, broken = [], [], [], [], [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            if text.isascii():
                continue
            keep.append(k)
            words.append(_DAMAGED.findall(text))
            left = text.encode("ascii", "ignore")
            bare.append(xxhash.xxh64_intdigest(left) - (1 << 63) if len(left) >= 20 else None)
            whole.append(xxhash.xxh64_intdigest(text) - (1 << 63) if len(left) >= 20 else None)
            chars.append([c for c in set(text) if c > "\x7f"])
            broken.append(any(_BROKEN.match(c) for c in chars[-1]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(words, pa.list_(pa.string())), pa.array(bare, pa.int64()), pa.array(whole, pa.int64()), pa.array(chars, pa.list_(pa.string())), pa.array(broken, pa.bool_())], ["id", "ws", "bare", "whole", "chars", "broken"])


def _undo_all(steps: list[tuple[str, str]], alphabet: frozenset[str], usual: dict[str, float]) -> Callable:
    """Every step's reading of every word; a single-byte step must not give rarer characters than it was given."""

    def common(word: str) -> float:
        runs = [usual.get(c, 0.0) for c in word.lower() if c > "\x7f"]
        return sum(runs) / max(1, len(runs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, step in enumerate(steps):
                    back = undo_word(word, step, alphabet) if applies(word, step) else None
                    if back is not None and back != word and (step[0] in MULTI or common(back) >= common(word)):
                        out.append((word, n, k, back))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string()))], ["word", "n", "step", "back"])

    return run


def cover(rows: list, tried: list[tuple[str, str]], known: list[tuple[str, str]], least: int) -> list[tuple[str, str]]:
    """Steps that explain things which neither ``known`` nor steps before them explain, the best first.

    ``rows`` are (steps, k): k runs or words that just these steps explain.  A step must explain ``least`` of what is
    left; UTF-8, which decodes strictly or not at all, but one."""
    left = [(set(r.steps), r.k) for r in rows if not any(tried[s] in known for s in r.steps)]
    out = []
    while left:
        gain: Counter = Counter()
        for steps, k in left:
            for s in steps:
                gain[s] += k
        good = [s for s in gain if gain[s] >= (1 if tried[s][0] == "utf_8" else least)]
        if not good:
            break
        best = max(good, key=lambda s: (gain[s], -s))
        out.append(tried[best])
        left = [(steps, k) for steps, k in left if best not in steps]
    return out


def _replace_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, step, back): words with the runs replaced that have a learned counterpart."""
    for batch in batches:
        back = []
        for word, runs in zip(batch.column("word").to_pylist(), batch.column("runs").to_pylist()):
            to = {r["garbled"]: r["clean"] for r in runs}
            back.append(_RUN.sub(lambda m, to=to: to.get(m.group(), m.group()), word))
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array([-1] * len(back), pa.int32()), pa.array(back, pa.string())], ["word", "n", "step", "back"])


def survey(chunks: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """The staged survey of all texts (see ``_survey``); rows without key or text are left out."""
    filled = chunks.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = chunks.schema[key].dataType.simpleString()
    return staged(filled.mapInArrow(_survey, f"id {kind}, ws array<string>, bare long, whole long, chars array<string>, broken boolean"), "texts")


def garbled_words(seen: DataFrame, least_runs: int = 2, sure: float = 0.6, plain: bool = True) -> tuple[DataFrame, DataFrame]:
    """Words of the surveyed texts that a wrong decoding made, with what they were.

    Twins: words that agree once non-ASCII characters are stripped are joined with the most frequent of them, and
    so are words at the same place of records that agree when stripped whole.  Aligning their characters gives
    (garbled, clean) runs.  The encoding steps that explain at least ``least_runs`` different runs (UTF-8: one) are
    learned; runs that no step explains are learned as they are, if they become fewer characters, all letters (signs are often
    varied on purpose), and three twins or more agree.
    A learned multi-byte step is believed wherever it decodes a whole run into characters that three texts or words
    hold, or UTF-8 into such of three or four bytes, a learned run wherever it occurs whole; a single-byte step where
    the word it gives is more frequent than the word found, or the word has a character of whose occurrences at least
    the share ``sure`` was found in such words.

    With ``plain``, steps are taken too that alignment cannot show, as there is nothing to align.
    Words of which stripping leaves nothing (Cyrillic) are joined with what each Cyrillic step makes of them; of the
    steps that give more frequent words the best is learned, the words it explains are put aside, and so on while a
    step explains ``least_runs`` other words (UTF-8: one).  UTF-8 read as Latin-1 needs no proof: the control characters
    it leaves decode strictly or not at all.  Nor does UTF-8 of four bytes read as cp1252, as nothing else looks like it.

    What a single-byte step leaves with one letter at most, and a Cyrillic word that is read as other Cyrillic and
    known by its characters only, is ``weak``: a record must hold a firm word of the same step (or see ``garbled_records``).

    Returns (garbled, words): (word, back, step, weak) and (id, word) of every word with characters beyond ASCII.
    """
    words = seen.select("id", F.explode(F.array_distinct("ws")).alias("word"))
    count = staged(words.groupBy("word").agg(F.count("*").alias("n")), "wordcounts")
    # twins by word: all words of one stripped form against the most frequent of them
    bare = count.withColumn("bare", F.regexp_replace("word", "[^\\x00-\\x7F]+", "")).filter(F.length("bare") >= 3)
    top = bare.groupBy("bare").agg(F.max(F.struct("n", "word")).alias("top"))
    twins = bare.join(top, "bare").filter((F.col("word") != F.col("top.word")) & (F.col("top.n") > F.col("n"))).select(F.col("word").alias("garbled"), F.col("top.word").alias("clean"))
    # twins by record: texts that agree when stripped whole, word by word, the more frequent word taken as clean
    keyed = seen.filter("bare is not null").groupBy("bare", "whole").agg(F.min("id").alias("id"))  # of copies one is enough
    first = keyed.groupBy("bare").agg(F.min("id").alias("one"), F.count("*").alias("n")).filter("n > 1")
    near = staged(keyed.join(first, "bare").filter("id != one").select("id", "one"), "twins")
    wanted = staged(near.select(F.explode(F.array("id", "one")).alias("id")).distinct(), "twinids")
    some = staged(seen.select("id", "ws").join(wanted, "id", "left_semi").dropDuplicates(["id"]), "twinwords")
    both = near.join(some, "id").withColumnRenamed("ws", "x").join(some.withColumnRenamed("id", "one").withColumnRenamed("ws", "y"), "one").filter(F.size("x") == F.size("y"))
    zipped = both.select(F.explode(F.arrays_zip("x", "y")).alias("p")).filter("p.x != p.y").select("p.x", "p.y").distinct()
    by_record = zipped.join(count.select(F.col("word").alias("x"), F.col("n").alias("nx")), "x").join(count.select(F.col("word").alias("y"), F.col("n").alias("ny")), "y")
    swap = F.col("nx") > F.col("ny")
    by_record = by_record.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("garbled"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("clean"))
    pairs = twins.unionByName(by_record).distinct()
    aligned = pairs.mapInArrow(_aligned, "garbled string, clean string, steps array<int>, n long").groupBy("garbled", "clean").agg(F.first("steps").alias("steps"), F.sum("n").alias("n"))
    aligned = staged(aligned, "aligned")
    strict_ = F.exists("steps", lambda x: x.isin([k for k, s in enumerate(STEPS) if s[0] == "utf_8"]))
    # one row per set of steps that explain the same runs: bounded by the encodings, not by the collection
    explained = aligned.filter((F.size("steps") > 0) & ((F.col("n") >= 2) | strict_)).groupBy("steps").agg(F.count("*").alias("k")).collect()
    steps = cover(explained, list(STEPS), [], least_runs)
    letters = count.select("n", F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.sum("n").alias("n")).filter("n >= 3 and c >= ' ' and c != '�'").collect()
    every = seen.select(F.explode("chars").alias("c")).groupBy("c").agg(F.count("*").alias("n")).filter("n >= 3 and c != '�'").collect()
    alphabet = frozenset(r.c for r in (*letters, *every))
    folded: Counter = Counter()
    for r in letters:
        folded[r.c.lower()] += r.n
    usual = {c: log1p(n) for c, n in folded.items()}
    if plain:
        hollow = count.filter((F.length("word") >= 4) & ~F.col("word").rlike("[\\x00-\\x7F]"))
        tried = [(t, w) for t in (*CYRILLIC, "utf_8") for w in WRONG if t != w]
        guess = hollow.mapInArrow(_undo_all(tried, alphabet, usual), "word string, n long, step int, back string")
        guess = guess.join(count.select(F.col("word").alias("back"), F.col("n").alias("m")), "back").filter("m > n")
        guess = guess.groupBy("word").agg(F.sort_array(F.collect_set("step")).alias("steps")).groupBy("steps").agg(F.count("*").alias("k")).collect()
        steps += cover(guess, tried, steps, least_runs)
    for wrong in sorted({w for _, w in steps}):
        if ("utf_8", wrong) not in steps and any(w == wrong and t in MULTI for t, w in steps):
            steps.append(("utf_8", wrong))
    if plain:
        if ("utf_8", "cp1252") not in steps and not count.filter(F.col("word").rlike(_ASTRAL)).isEmpty():
            steps.append(("utf_8", "cp1252"))
        if ("utf_8", "latin_1") not in steps:
            steps.append(("utf_8", "latin_1"))
    cand = count.mapInArrow(_undo_all(steps, alphabet, usual), "word string, n long, step int, back string")
    # runs that no step explains, as they were aligned: of several counterparts the one four in five twins agree on
    runs = aligned.filter((F.size("steps") == 0) & (F.length("garbled") >= 2) & (F.length("clean") < F.length("garbled")) & F.col("clean").rlike("^\\p{L}+$") & ~F.col("garbled").contains(F.col("clean")))
    runs = runs.join(aligned.filter(F.size("steps") > 0).select("garbled").distinct(), "garbled", "left_anti")
    runs = runs.groupBy("garbled").agg(F.max(F.struct("n", "clean")).alias("top"), F.sum("n").alias("all")).filter("top.n >= 3 and top.n >= 0.8 * all").select("garbled", F.col("top.clean").alias("clean"))
    in_runs = count.select("word", "n", F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit("[^\\x00-\\x7F]+"), F.lit(0)))).alias("garbled"))
    learned = in_runs.join(runs, "garbled").groupBy("word", "n").agg(F.collect_list(F.struct("garbled", "clean")).alias("runs"))
    cand = staged(cand.unionByName(learned.mapInArrow(_replace_runs, "word string, n long, step int, back string")), "undone")
    multi = [-1, *(k for k, s in enumerate(steps) if s[0] in MULTI)]
    is_multi = F.col("step").isin(multi)
    sure_words = cand.filter(is_multi).withColumn("m", F.lit(1 << 40).cast("long"))
    single = cand.filter(~is_multi).join(count.select(F.col("word").alias("back"), F.col("n").alias("m")), "back", "left").select(*cand.columns, "m")
    proven = single.filter("m > n")
    proof = proven.groupBy("word").agg(F.max(F.struct("m", "step", "back")).alias("b"), F.max("n").alias("n"))
    in_word = F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit("[^\\x00-\\x7F]"), F.lit(0)))).alias("c")
    have = count.filter(F.length("word") >= 2).select("n", in_word).groupBy("c").agg(F.sum("n").alias("all"))
    known = proof.select("n", "b.step", in_word).groupBy("c", "step").agg(F.sum("n").alias("k"))
    strong = known.join(have, "c").filter(F.col("k") >= F.lit(sure) * F.col("all")).select("c", "step")
    by_char = single.filter("m is null").select("word", "n", "step", "back", in_word).join(F.broadcast(strong), ["c", "step"]).select("word", "n", "step", "back").distinct().withColumn("m", F.lit(0).cast("long"))
    everything = sure_words.select("word", "back", "step", "m").unionByName(proven.select("word", "back", "step", "m")).unionByName(by_char.select("word", "back", "step", "m"))
    best = everything.groupBy("word").agg(F.max(F.struct("m", (F.when(F.col("step") < 0, 1 << 20).otherwise(F.col("step")) * -1).alias("s"), "back", "step")).alias("b"))
    best = best.select("word", F.col("b.back").alias("back"), F.col("b.step").alias("step"), (F.col("b.m") == 0).alias("unproven"))
    swapped = [k for k, (true, wrong) in enumerate(steps) if true in CYRILLIC and wrong in CYRILLIC]
    by_letters = F.col("step").isin(swapped) & F.col("unproven") if swapped else F.lit(False)
    bare_letter = ~F.col("step").isin(multi) & (F.length(F.regexp_replace("back", "\\P{L}", "")) <= 1)
    return best.withColumn("weak", bare_letter | by_letters).drop("unproven"), words


#: What Shift-JIS bytes are when they are read as cp1252: a lead, then leads and trail bytes, of which some are ASCII.
_PAIRS = re.compile("[" + re.escape("".join(_BYTES["cp1252"])) + "][@-~" + re.escape("".join(_BYTES["cp1252"])) + "]+")


def _undo_shift_jis(text: str) -> str:
    """Stretches that are Shift-JIS read as cp1252 put back, where they decode to Japanese without rest."""

    def back(m: re.Match) -> str:
        raw = bytes(_BYTES["cp1252"].get(c, ord(c) & 0xFF) for c in m.group())
        for end in range(len(raw), max(1, len(raw) - 6), -1):
            try:
                got = raw[:end].decode("shift_jis")
            except UnicodeDecodeError:
                continue
            if all("　" <= c <= "鿿" or "＀" <= c <= "￯" for c in got):
                return got + m.group()[end:]
            return m.group()
        return m.group()

    return _PAIRS.sub(back, text)


def garbled_records(chunks: DataFrame, key: str = "id", text: str = "text", plain: bool = True, broadcast_words: int = 300_000, salts: int = 32) -> DataFrame:
    """(key, restored, lost, n_words): records with garbled text.

    ``restored`` is the text with every garbled word put back, ``lost`` tells that characters are gone for good
    (replacement characters, or control characters that nothing explains), so it is restored in part at most.  In a
    record without a firm word, letters that stand for signs count only between longer words.  With ``plain``, records
    with lost or control characters are cases by these alone, and stretches of Shift-JIS read as cp1252 are decoded
    again; without, only what twins, alignment and the mappings learned from them give (see ``garbled_words``).
    Rows without key or text and empty texts are no case.  Repeated rows give repeated results.
    """
    seen = survey(chunks, key, text)
    garbled, words = garbled_words(seen, plain=plain)
    garbled = staged(garbled, "garbled")
    n_garbled = garbled.count()
    if n_garbled <= broadcast_words:
        met = words.join(F.broadcast(garbled), "word")
    else:  # a frequent word must not meet all its records in one task
        spread = garbled.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = words.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(spread, ["word", "salt"])
    hit = met.groupBy("id").agg(F.collect_set(F.struct("word", "back", "step", "weak")).alias("fix"))  # at most one text's words
    firm = F.transform(F.filter("fix", lambda x: ~x["weak"]), lambda x: x["step"])
    sign = lambda x: x["word"].rlike("^\\p{L}$") & ~x["back"].rlike("\\p{L}")
    hit = hit.withColumn("fix", F.filter("fix", lambda x: ~x["weak"] | F.array_contains(firm, x["step"]) | sign(x))).filter(F.size("fix") > 0)
    hit = hit.select("id", F.struct(F.col("fix").alias("words"), (F.size(firm) == 0).alias("signs")).alias("fix"))
    if plain:
        hit = hit.join(seen.filter("broken").select("id").distinct(), "id", "full")
    hit = staged(hit, "cases")
    cases = F.broadcast(hit) if hit.count() <= 100_000 else hit
    rows = chunks.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")).join(cases, "id")

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts, sizes = [], [], []
            for k, (t, fix) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                back = {f["word"]: f["back"] for f in fix["words"]} if fix else {}
                if fix and fix["signs"]:  # single letters for signs: only between longer words, not in spaced-out ones
                    back = {w: b for w, b in back.items() if re.search(rf"\w\w\W*\s{re.escape(w)}\s\W*\w\w", t)}
                if not back and not (plain and _BROKEN.search(t)):
                    continue
                keep.append(k)
                out = _WORD.sub(lambda m, back=back: back.get(m.group(), m.group()), t) if back else t
                texts.append(_undo_shift_jis(out) if plain and _BROKEN.search(out) else out)
                sizes.append(len(back))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(texts, pa.string()), pa.array(sizes, pa.int32())], ["id", "restored", "n_words"])

    out = rows.select("id", "text", "fix").mapInArrow(restore, f"id {chunks.schema[key].dataType.simpleString()}, restored string, n_words int")
    return out.select(F.col("id").alias(key), "restored", F.col("restored").rlike(LOST + "|" + CONTROL).alias("lost"), "n_words")
