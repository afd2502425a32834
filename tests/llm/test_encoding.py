from quire.llm import encoding

WORDS = "Die Prüfung für das Gefäß wurde früh bestätigt und über Nacht später geprüft während größer".split()
STEPS = [("utf_8", "cp1252"), ("utf_8", "mac_roman"), ("cp1252", "mac_roman")]


def garble(text, step):
    true, wrong = step
    out = ""
    for c in text:
        if c < "\x80":
            out += c
        else:
            out += "".join(encoding._CHARS[wrong][b] for b in c.encode(true))
    return out


def test_undo_is_the_inverse():
    for step in STEPS:
        for w in WORDS:
            if not w.isascii():
                assert encoding.undo_word(garble(w, step), step, None) == w
    twice = garble(garble("Prüfung", STEPS[0]), STEPS[0])
    assert encoding.undo_word(twice, STEPS[0], None) == "Prüfung"
    assert encoding.undo_word("ÂGE", STEPS[0], frozenset("ä")) is None


def test_align():
    assert encoding.align("PrÃ¼fung", "Prüfung") == [("Ã¼", "ü")]
    assert encoding.align("abc", "abd") == []


def texts():
    clean = [(n, " ".join([*WORDS, f"Nr {n}"])) for n in range(12)]
    bad = [(100 + n, " ".join([*(garble(w, STEPS[n % 3]) for w in WORDS), f"Nr {n}"])) for n in range(9)]
    return clean, bad


def test_finds_and_restores(spark):
    clean, bad = texts()
    rows = [*clean, *bad, (200, None), (201, ""), (202, "lost Z�rich"), (203, "A sign “ÂGE D’OR – ŒUVRES” and Ærøvang, ½ of 9 °C ¶ as meant"), (100, bad[0][1]), (204, "x" * 200_000 + " " + garble("Prüfung", STEPS[0]))]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "id long, text string, word string, n int")
    got = encoding.garbled_records(df).collect()
    assert {r.id for r in got} == {i for i, _ in bad} | {202, 204}
    by = {r.id: r for r in got}
    for n, (i, _) in enumerate(bad):
        assert by[i].restored == " ".join([*WORDS, f"Nr {n}"]) and not by[i].lost
    assert by[202].lost and by[202].n_words == 0
    assert by[204].restored.endswith(" Prüfung")
    assert sum(r.id == 100 for r in got) == 2  # a repeated row gives a repeated result


def test_empty_tables(spark):
    for rows in ([], [(1, None)], [(1, "plain")]):
        assert encoding.garbled_records(spark.createDataFrame(rows, "id long, text string")).count() == 0


CYRILLIC = "поэтому пожилой рабочий осторожно проверил старый механизм вечером после дождя".split()


def test_two_cyrillic_kinds_read_as_one(spark):
    clean = [(n, " ".join(CYRILLIC)) for n in range(9)]
    kinds = [("cp1251", "cp1252")] * 4 + [("koi8_r", "cp1252")] * 3 + [("utf_8", "cp1251")] * 2
    bad = [(100 + n, " ".join(garble(w, k) for w in CYRILLIC)) for n, k in enumerate(kinds)]
    df = spark.createDataFrame([*clean, *bad], "id long, text string")
    got = {r.id: r.restored for r in encoding.garbled_records(df).collect()}
    assert got == {i: " ".join(CYRILLIC) for i, _ in bad}


def test_utf_8_read_as_latin_1(spark):
    bad = {1: "Zgłosił Übung straße", 2: "10€ and so on…"}
    clean = [(10 + n, "Zgłosił coś, Übung auf der straße … 5€ " + str(n)) for n in range(4)]
    df = spark.createDataFrame([*clean, *((i, t.encode().decode("latin_1")) for i, t in bad.items())], "id long, text string")
    got = {r.id: (r.restored, r.lost) for r in encoding.garbled_records(df).collect()}
    assert got == {i: (t, False) for i, t in bad.items()}


def test_characters_the_collection_does_not_have(spark):
    bad = {1: "well done 😀 and thanks", 2: "great👍 indeed", 3: "all of it ✓ is done"}
    rows = [*((i, garble(t, ("utf_8", "cp1252"))) for i, t in bad.items()), (4, "clean 😀 here"), (5, "Ёлка и сад, plášť")]
    got = {r.id: r.restored for r in encoding.garbled_records(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == bad
    assert encoding.undo_word("сад", ("utf_8", "cp866"), frozenset("сад")) is None
    assert encoding.undo_word("plášť", ("utf_8", "cp1250"), frozenset("áš")) is None


def test_method_alone_needs_twins(spark):
    clean, bad = texts()
    rows = [*clean, *bad, (202, "lost Z\ufffdrich"), (300, " ".join(garble(w, ("cp1251", "cp1252")) for w in CYRILLIC))]
    rows += [(400 + n, " ".join(CYRILLIC)) for n in range(5)]
    got = {r.id: r.restored for r in encoding.garbled_records(spark.createDataFrame(rows, "id long, text string"), plain=False).collect()}
    assert got == {i: " ".join([*WORDS, f"Nr {i - 100}"]) for i, _ in bad}  # neither lost characters nor what leaves nothing to align


def test_runs_that_no_step_explains_are_learned(spark):
    words = ["früh", "für", "über", "grün", "müde", "kühl", "süß"]
    clean = [(n, " ".join(words)) for n in range(9)]
    odd = [(20, " ".join(w.replace("ü", "§§·") for w in words[:6])), (21, "das fünfte Gemüse".replace("ü", "§§·"))]
    got = {r.id: r.restored for r in encoding.garbled_records(spark.createDataFrame([*clean, *odd], "id long, text string"), plain=False).collect()}
    assert got == {20: " ".join(words[:6]), 21: "das fünfte Gemüse"}


def test_hot_words_are_salted_and_null_keys_left_out(spark):
    clean, bad = texts()
    rows = [*clean, *bad, (None, bad[0][1]), (500, bad[0][1])]
    df = spark.createDataFrame(rows, "id long, text string")
    want = {(r.id, r.restored) for r in encoding.garbled_records(df).collect()}
    assert {i for i, _ in want} == {i for i, _ in bad} | {500}
    assert {(r.id, r.restored) for r in encoding.garbled_records(df, broadcast_words=0, salts=3).collect()} == want
