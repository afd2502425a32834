from quire.llm import scans

BODY = "The storekeeper keeps the steady ledger beside the bench and the harbour office tested the second sample on Monday morning"
LEX = {w: 200 for w in BODY.lower().split()} | {"tie-up": 50, "measurement": 80}


def decoder():
    return scans.Decoder(dict(LEX))


def test_confusions_strays_and_spaced_words():
    d = decoder()
    text = "The st0rekeeper keeps the steacly ledger~ beside the b e n c h and tested , the second"
    assert sorted(n for _, _, n in d.bad_words(text)) == sorted(["storekeeper", "steady", "", "bench", ""])
    assert d.bad_words(BODY) == []
    assert d.bad_words("See BJ-240 and FE3865 at Kéwick by Nimaarörk on 12 µm") == []


def test_broken_words():
    d = decoder()
    hit = lambda t: [m.group() for m in scans._BREAK.finditer(t) if d.broken(*m.groups())]
    assert hit("the store-\nkeeper keeps") and hit("the measure- ment") and hit("the har¬\nbour") and hit("the har­ bour")
    assert not hit("the tie-\nup chart") and not hit("BJ-\n240")


def test_decode_joins_and_splits():
    d = decoder()
    assert [w[0] for w in d.decode("thesteady ledger")[1]] == ["the", "steady", "ledger"]
    assert [w[0] for w in d.decode("l e d g e r")[1]] == ["ledger"]
    assert [w[0] for w in d.decode("measure-\nment")[1]] == ["measurement"]


def test_page_number_lines():
    for line in ("— 32 —", "- 5 -", "Page 69", "p. 101", "[97]", "122 / 332", "ii", "Wax foundation   178", "179   Wax foundation"):
        assert scans.page_number_line(line), line
    for line in ("In 1984 we met", "the end.", "I think", "| 3 | 4 |"):
        assert not scans.page_number_line(line), line
    assert scans.number_of("9O") == 90 and scans.number_of("l31") == 131 and scans.number_of("ii") is None


def test_paragraphs_break_after_short_closed_lines():
    got = scans.paragraphs(["a long line that runs to the very end of", "it and stops.", "Then another paragraph starts that also is", "long and ends here."])
    assert [len(p) for p in got] == [2, 2]
    assert scans.paragraphs([]) == [] and scans.paragraphs([""]) == []


def fixture(spark):
    rows, n = [], 0
    title = "Steady ledger Kewick"
    for page in range(1, 7):
        text = f"{title.upper()}\n" + ("" if page > 1 else f"{title}\n") + BODY + f".\nPage {40 + page}"
        rows.append((page, "d1", page - 1, page, str(40 + page), text))
    rows[3] = (4, "d1", 3, 4, "4A", "STEADY LEDGFR KEWICK\nThe st0rekeeper keeps the steacly ledger.\n— 44 —")
    rows[4] = (5, "d1", 4, 5, None, "The measure-\nment of the second sample.")
    for n in range(6):  # plain pages, so that words have counts
        rows.append((100 + n, f"p{n}", 0, 1, None, (BODY + " with its measurement. ") * 3))
    rows += [(200, "d2", 0, None, None, "No page here"), (201, "d3", 0, 1, None, None), (202, "d4", 0, 1, None, ""), (1, "d1", 0, 1, "41", rows[0][5])]
    chunks = spark.createDataFrame([(*r, "k", 1) for r in rows], "id long, document_id string, seq int, page_number int, printed_label string, text string, key string, times int")
    docs = spark.createDataFrame([("d1", title), ("d2", None), ("p0", "")], "document_id string, title string")
    return chunks, docs


def test_noise_kinds(spark):
    got = {(r.id, r.noise) for r in scans.page_noise(*fixture(spark)).collect()}
    want = {(i, "page_number") for i in (1, 2, 3, 4, 6)} | {(i, "header") for i in (1, 2, 3, 4, 6)} | {(4, "chars"), (4, "label"), (5, "hyphen")}
    assert got == want


def test_pages_of_hot_documents_are_spread(spark):
    chunks, docs = fixture(spark)
    want = {(r.id, r.noise) for r in scans.page_noise(chunks, docs).collect()}
    got = scans.page_facts(chunks, docs, hot_rows=2).select("id", "noise").collect()
    assert {(r.id, k) for r in got for k in r.noise} == want


def test_repaired(spark):
    by = {r.id: r for r in scans.repaired_pages(*fixture(spark)).collect()}
    assert by[4].text == "The storekeeper keeps the steady ledger." and by[4].label == "44"
    assert by[5].text == "The measurement of the second sample."
    assert by[2].text == BODY + "."


def test_empty(spark):
    chunks, docs = fixture(spark)
    assert scans.page_noise(chunks.limit(0), docs.limit(0)).count() == 0


def test_unknown_stretches_are_decoded():
    d = decoder()
    assert scans.repair(d, "We saw thesteady ledger beside the har bour office", set()) == ["We saw the steady ledger beside the harbour office"]
    assert scans.repair(d, "the mea-\nsure ment of the @fternoon and @ledger", set()) == ["the measurement of the @fternoon and @ledger"]
    assert [n for _, _, n in d.bad_words("see the 0ffice and the †ested bench")] == ["office", "tested"]
    assert d.bad_words("We saw thesteady ledger") == []  # no character is misread
    assert d.heal("the mea-\nsure ment")[0] and not d.heal("the tie-\nup chart")[0]


def test_words_run_together_and_torn_apart_are_repaired():
    d = scans.Decoder({w: 200 for w in "he went in the house and saw a garden".split()})
    assert scans.repair(d, "he went inthe ho use and saw.", set()) == ["he went in the house and saw."]


def test_one_confusion_all_over_a_word():
    d = scans.Decoder({**LEX, "rejected": 90})
    assert d.word("rcjcctcd")[1:] == ("rejected", 3)


def pages_of(spark, pages, plain):
    rows = [(n, f"d{n}", 0, 1, None, t) for n, t in enumerate(pages)] + [(1000 + n, f"e{n}", 0, None, None, t) for n, t in enumerate(plain)]
    return spark.createDataFrame(rows, "id long, document_id string, seq int, page_number int, printed_label string, text string")


WORDS = "lantern window winter wander wonder dinner pantry tenant banner sender candle bundle mantle".split()


def test_confusions_are_learned_from_pages(spark):
    misread = [w.replace("n", "ñ") for w in WORDS if w.count("n") == 1]
    chunks = pages_of(spark, [" ".join(misread), " ".join(WORDS)], [" ".join(WORDS)] * 30)
    model = scans.learn(chunks, support=5)
    assert ("ñ", "n") in model.learned
    d = model.decoder()
    assert [n for _, _, n in d.bad_words("the señder of the baññer")] == ["sender", "banner"]
    # met elsewhere as often: no confusion, but other words
    both = pages_of(spark, [" ".join(misread)], [" ".join(WORDS)] * 30 + [" ".join(misread)])
    assert scans.learn(both, support=5).learned == []


def test_rare_words_beyond_the_lexicon_are_asked_for(spark):
    docs = spark.createDataFrame([], "document_id string, title string")
    page = "the corn and the dorn here now"
    common = "the com and the dom here now " * 40
    chunks = pages_of(spark, [page, page.replace("corn", "c0rn")], [common] * 3 + ["corn corn corn"])
    few = scans.learn(chunks, most_words=6)
    assert "com" in few.counts and "corn" not in few.counts and few.rarer is not None
    facts = {r.id: (list(r.own), list(r.noise)) for r in scans.page_facts(chunks, docs, few).collect()}
    assert facts[0][0] == ["corn"] and facts[0][1] == []  # corn is a word, though a rare one; one bad word is no case
    assert facts[1][0] == []


def test_method_alone(spark):
    by = {r.id: r for r in scans.repaired_pages(*fixture(spark), plain=False).collect()}
    assert by[5].broken == 1 and by[5].text == "The measurement of the second sample." and by[4].bad == 2
    assert by[4].text == "The storekeeper keeps the steady ledger."


def test_roman_numbers(spark):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(1, 4000).select(scans._roman(F.col("id"))).orderBy("id").collect()]
    assert got[3] == "iv" and got[399] == "cd" and got[1993] == "mcmxciv" and len(set(got)) == 3999


def test_all_words_count_however_few_are_held_in_memory(spark):
    chunks, docs = fixture(spark)
    rare = pages_of(spark, ["the thresho1d of the thre- shold and the gramm@r", "the corn, the inforrnation " + "rejccted " * 6 + "rejcctcd " * 4], ["threshold grammar corn"] * 4 + ["information com rejected " * 400, "inforrnation " * 3])
    chunks = chunks.select(rare.columns).union(rare.withColumn("id", rare.id + 5000))
    docs = docs.select("document_id", "title")
    whole = scans.learn(chunks)
    assert whole.rarer is None and "threshold" in whole.counts and not {"inforrnation", "rejccted", "rejcctcd"} & set(whole.counts)

    def rows(model):
        return {(r.id, tuple(r.noise), tuple(sorted(r.headers)), r.right_label) for r in scans.page_facts(chunks, docs, model).collect()}

    texts = ["the thresho1d of the thre- shold", "the corn, the inforrnation, gramm@r and thegrammar", "st0rekeeper measure-\nment"]
    want, mended = rows(whole), [scans.repair(whole.decoder(), t, set()) for t in texts]
    assert (5000, ("hyphen", "chars")) in {r[:2] for r in want} and mended[0] == ["the threshold of the threshold"]
    for most in (0, 2, 6):  # fewer than one bin holds, too
        few = scans.learn(chunks, most_words=most)
        assert len(few.counts) <= most and {**few.counts, **{r.w: r.n for r in few.rarer.collect()}} == whole.counts
        assert rows(few) == want and [scans.repair(few.decoder(), t, set()) for t in texts] == mended


def test_confusions_lead_to_all_frequent_words(spark):
    marks = [chr(0x4E00 + k) for k in range(250)]  # more confusions than were kept, each as often as the next
    misread = [w.replace("n", m, 1) for w in WORDS[:3] for m in marks]
    chunks = pages_of(spark, [" ".join(misread)], [" ".join(WORDS)] * 30)
    whole = scans.learn(chunks, support=3)
    assert set(whole.learned) >= {(m, "n") for m in marks}
    assert scans.learn(chunks, support=3, most_frequent=2).learned == whole.learned
    double = pages_of(spark, [" ".join(w.replace("n", "ñ", 1) for w in WORDS), " ".join(w.replace("n", "xx", 1) for w in WORDS)], [" ".join(WORDS)] * 30 + ["laxxtern"])
    whole = scans.learn(double, support=5)
    assert {("ñ", "n"), ("xx", "n")} <= set(whole.learned) and scans.learn(double, support=5, most_frequent=0).learned == whole.learned
