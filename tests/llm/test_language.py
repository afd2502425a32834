import os

import pandas as pd
import pytest

from quire.llm import language

EN = ["The committee returned the spare part before the storm.", "Nobody had counted the entries since the auditor left.", "What matters here is the report, not the drawing.", "The table lists every value with its note.", "Each crew carries a narrow mark, except the one we moved.", "It is unclear whether the pump or the valve caused the late result.", "We cleaned the frame and found the sample stable."]
DE = ["Niemand weiß genau, warum das Lager so günstig wirkt.", "Wir haben die Pumpe nach der Prüfung abgelehnt.", "Mit vielen Litern pro Minute bleibt die Strömung zuverlässig.", "Es wäre möglich, dass das Gefäß müde ist.", "Der Bericht erwähnt das Ventil, aber nicht die Anlage.", "Zwischen den Häusern liegt die Schleuse, und dort ist es trocken.", "Für die Werkstatt fehlt noch das Gerüst."]
JA = ["危ないポンプを登録するには時間がかかります。", "なぜ新しいポンプだけが残ったのか、まだ分かりません。", "担当者は慎重に灯台を確認しました。", "桟橋は使えません。", "資料によると、報告書は必要です。"]


def samples(spark):
    rows = [("en", t) for t in EN[:4]] + [("de", t) for t in DE[:4]] + [("ja", t) for t in JA[:3]] + [(None, "x"), ("en", None)]
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "sample_id int, lang string, text string")


def test_documents_and_stretches(spark):
    docs = [
        (1, " ".join(EN[4:]), "en-GB"),
        (2, " ".join(EN[4:]), "de"),
        (3, " ".join(DE[3:]), None),
        (4, " ".join(EN) + "\n\n" + " ".join(DE[3:6]) + "\n\n" + " ".join(EN[:3]), "English"),
        (5, " ".join(EN[:3]) + " " + DE[4] + " " + " ".join(EN[3:]), "eng"),
        (6, "".join(JA), "JPN"),
        (7, None, "en"),
        (8, "", "und"),
        (9, "12 34 !!", "xx"),
        (10, DE[5], "unknown"),
        (11, " ".join(EN * 400), "EN"),
    ]
    df = spark.createDataFrame([(*d, "s", 0.5) for d in docs], "doc_id long, text string, lang string, main string, confidence double")
    out = language.identify_languages(df, samples(spark))
    by = {r.doc_id: r for r in out.collect()}
    assert [by[k].main for k in range(1, 12)] == ["en", "en", "de", "en", "en", "ja", None, None, None, "de", "en"]
    assert [(s.lang, s.sentences) for s in by[4].segments] == [("en", 7), ("de", 3), ("en", 3)]
    seg = by[4].segments[1]
    assert docs[3][1][seg.start : seg.end].strip() == " ".join(DE[3:6])
    assert all(0 <= r.confidence <= 1 for r in by.values())
    got = {(r.doc_id, r.lang) for r in language.language_cases(out).collect()}
    assert got == {(2, "en"), (3, "de"), (4, "en"), (4, "de"), (10, "de")}


def test_held_out_accuracy_on_sentences():
    model = language.Profiles([("en", t) for t in EN[:4]] + [("de", t) for t in DE[:4]] + [("ja", t) for t in JA[:3]])
    cos, _ = model.cosines(EN[4:] + DE[4:] + JA[3:])
    want = ["en"] * 3 + ["de"] * 3 + ["ja"] * 2
    assert sum(model.langs[k] == w for k, w in zip(cos.argmax(1), want)) >= 7


def test_held_out_accuracy_on_the_samples():
    path = "/root/testdata/sf0.001/lang_samples.parquet"
    if not os.path.exists(path):
        pytest.skip("no samples here")
    rows = pd.read_parquet(path).sort_values("sample_id")
    held = rows.sample_id % 4 == 0
    model = language.Profiles(list(zip(rows.lang[~held], rows.text[~held])))
    cos, _ = model.cosines(rows.text[held].tolist())
    assert (pd.Series([model.langs[k] for k in cos.argmax(1)], index=rows.index[held]) == rows.lang[held]).mean() >= 0.98


def test_cached_products_equal_the_definition():
    model = language.Profiles([("en", EN[0]), ("de", DE[0])], dim=256)
    keys, _ = model.trigrams("hello there")
    assert (abs(model.scores(keys) - model.encode(keys).astype("float32") @ model.protos.T) < 1e-3).all()
    assert (model.scores(keys) == model.scores(keys)).all()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.language_cases(language.identify_languages(df, samples(spark))).count() == 0
    one = spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string")
    assert language.identify_languages(one, samples(spark).limit(0)).first().main is None
