from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quire.api import Config, Library, ToolError, redact
from quire.operators.hybrid import Filters
from quire.plans import ingest
from quire.sources import pdf
from quire.sources.markup import parse_text
from quire.streaming.watch import watch

NOW = datetime(2025, 1, 1, 12, 0, 0)
FRESH, OLD = datetime(2025, 1, 1, 11, 57), datetime(2025, 1, 1, 11, 0)


def test_claim_outcomes(spark):
    docs = [("a", "S1", "p/one.md", "processing", FRESH), ("b", "s2", "p/two.md", "ready", OLD), ("c", "s9", "P/TWO.md", "ready", OLD), ("d", "s3", "p/three.md", "failed", OLD), ("e", "s4", "p/four.md", "processing", OLD), ("f", "s5", "p/five.md", "processing", FRESH), ("g", None, "p/six.md", "ready", OLD), ("h", "s7", "p/seven.md", "processing", None)]
    d = spark.createDataFrame(docs, "document_id string, sha256 string, source_path string, ingest_status string, updated_at timestamp").withColumn("error_message", F.lit(None).cast("string"))
    files = spark.createDataFrame([("s1", "x.md"), ("s2", "p/two.md"), ("s3", "p/three.md"), ("s4", "p/four.md"), ("new", "p/five.md"), ("new2", "p/two.md"), ("new3", "p/six.md"), ("s7", "p/seven.md"), ("s7", "p/seven.md")], "sha256 string, source_path string")
    got = {(r.sha256, r.source_path): (r.outcome, r.supersede) for r in ingest.claims(files, d, F.lit(NOW)).collect()}
    assert got == {
        ("s1", "x.md"): ("joined", []),
        ("s2", "p/two.md"): ("reused", ["c"]),
        ("s3", "p/three.md"): ("started", []),
        ("s4", "p/four.md"): ("started", []),
        ("new", "p/five.md"): ("error", []),
        ("new2", "p/two.md"): ("started", ["b", "c"]),
        ("new3", "p/six.md"): ("started", []),
        ("s7", "p/seven.md"): ("started", []),
    }
    state = {r.document_id: r.ingest_status for r in ingest.recover_interrupted(d, F.lit(NOW)).collect()}
    assert state["a"] == "processing" and state["e"] == "failed" and state["h"] == "failed" and state["b"] == "ready"
    renewed = {r.document_id: r.updated_at for r in ingest.renew(d, "e", F.lit(NOW)).collect()}
    assert renewed["e"] == NOW and renewed["b"] == OLD


@pytest.fixture
def index(spark, tmp_path):
    return ingest.Snapshots(spark, str(tmp_path / "index"))


def files(spark, *rows):
    return spark.createDataFrame([(p, "md", p[:-3], t) for p, t in rows], "source_path string, format string, title string, text string")


METHODS = "# Methods\n\n## Rope\n\nThe rope was tested on the quay.\n\n| load | kg |\n| --- | --- |\n| one | 3 |\n\n# Results\n\nIt held."
NOTES = "# Notes\n\nBadgers walk along the quay at night."


def test_ingest_search_supersede_delete(spark, index):
    first = ingest.ingest(index, files(spark, ("m.md", METHODS), ("n.md", NOTES), ("copy.md", NOTES), ("empty.md", "")), parse_text)
    assert {r.outcome for r in first.collect()} == {"started"}
    n = index.counts()
    assert n["documents"] == 3 and n["chunks"] == n["vectors"] == 5
    lib = Library(index)
    assert {r.ingest_status for r in lib.documents().collect()} == {"ready", "failed"}
    hits = lib.search("badgers at night").collect()
    assert hits[0].title in ("n", "copy") and "text" not in hits[0].asDict() and "Badgers" in hits[0].snippet
    tables = lib.search("load", filters=Filters(kind="table")).collect()
    assert [r.kind for r in tables] == ["table"]
    doc = hits[0].document_id
    ctx = lib.context(document_id=doc, seq=0).collect()
    assert "Badgers" in ctx[0].text and not ctx[0].has_more_after
    methods = lib.documents().filter("source_path = 'm.md'").first().document_id
    assert [r.title for r in lib.outline(methods).collect()] == ["Methods", "Rope", "Results"]
    assert [r.title for r in lib.outline(methods, 1).collect()] == ["Methods", "Results"]
    again = ingest.ingest(index, files(spark, ("m.md", METHODS + " Twice."), ("moved.md", NOTES)), parse_text)
    assert {(r.source_path, r.outcome) for r in again.collect()} == {("m.md", "started"), ("moved.md", "reused")}
    lib.refresh()
    assert {r.source_path for r in lib.documents().filter("ingest_status = 'ready'").collect()} == {"m.md", "moved.md"}
    counts = index.counts()
    assert counts["chunks"] == counts["vectors"] == 5
    # a replacement that fails leaves the old version
    ingest.ingest(index, files(spark, ("moved.md", "")), parse_text)
    lib.refresh()
    assert lib.search("badgers at night").count() > 0
    assert lib.delete(doc) == 1
    assert lib.documents().filter(F.col("document_id") == doc).count() == 0
    with pytest.raises(ToolError):
        lib.delete("nobody")
    for bad in (lambda: lib.search("x"), lambda: lib.outline("nobody"), lambda: lib.outline(methods, 7), lambda: lib.context(), lambda: lib.context(id=1)):
        with pytest.raises(ToolError):
            bad()


def test_other_model_is_refused(spark, index):
    ingest.ingest(index, files(spark, ("n.md", NOTES)), parse_text)
    with pytest.raises(ingest.IndexMismatch):
        index.check(model="other")


def test_stream_equals_batch(spark, index, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "m.md").write_text(METHODS)
    (src / "n.md").write_text(NOTES)
    watch(index, str(src), str(tmp_path / "ck"), once=True).awaitTermination()
    assert index.counts()["chunks"] == 5
    (src / "again.md").write_text(NOTES)
    (src / "t.txt").write_text("TITLE\n\nMore prose about the quay.")
    watch(index, str(src), str(tmp_path / "ck"), once=True).awaitTermination()
    n = index.counts()
    assert n["chunks"] == n["vectors"] == 6 and n["documents"] == 3


def test_config_and_redaction():
    c = Config.load(["--library=/lib", "--ocr=off"], {"QUIRE_INDEX": "/idx", "QUIRE_LIBRARY": "/env", "QUIRE_MAX_FILE_MB": "9"})
    assert (c.library, c.index, c.ocr, c.max_file_mb) == ("/lib", "/idx", False, 9)
    for argv in (["--library=/a"], ["--library=/a", "--index=/b", "--max-file-mb=0"], ["--library=/a", "--index=/b", "--ocr=maybe"], ["--nope=1"]):
        with pytest.raises(ToolError):
            Config.load(argv, {})
    assert redact("failed at /lib/sub/x in /lib", {"/lib": "<library>", "/lib/sub": "<sub>"}) == "failed at <sub>/x in <library>"


def test_a_folder_end_to_end(spark, index, tmp_path):
    from test_sources import docx, para

    lib = tmp_path / "lib"
    (lib / "sub").mkdir(parents=True)
    (lib / "m.md").write_text(METHODS)
    (lib / "sub" / "t.txt").write_text("TITLE\n\nMore prose about the quay.")
    (lib / "w.docx").write_bytes(docx(para("Top", "Heading1") + para("Word text on ropes.")))
    (lib / "page.txt").write_bytes(b"<html><body>x</body></html>")
    (lib / "broken.docx").write_bytes(b"PK not a zip")
    (lib / "scan.pdf").write_bytes(b"%PDF-1.7 pages")
    (lib / "big.txt").write_bytes(b"z" * 5000)

    def reader(content):
        run = lambda text, y: pdf.Run(text, 50, y, 6.0 * len(text), 11)
        return {"title": "Scanned", "pages": [[run("First page prose.", 700)], [run("Second page prose.", 700), run("2", 30)]]}

    done, totals = ingest.ingest_folder(index, str(lib), recursive=True, max_bytes=4000, pdf_reader=reader)
    assert tuple(totals.first()) == (4, 0, 3)
    docs = {r.source_path: r for r in index.read()["documents"].collect()}
    assert docs["page.txt"].error_message == "HTML is not supported" and docs["broken.docx"].error_message.startswith("unreadable")
    assert docs["w.docx"].title == "Top" and docs["sub/t.txt"].title == "TITLE" and docs["page.txt"].embedding_model is None
    assert (docs["scan.pdf"].title, docs["scan.pdf"].locator_scheme, docs["scan.pdf"].locator_count) == ("Scanned", "page", 2)
    pages = index.read()["chunks"].filter(F.col("document_id") == docs["scan.pdf"].document_id).orderBy("seq").collect()
    assert [(r.locator_type, r.page_number, r.text) for r in pages] == [("page", 1, "First page prose."), ("page", 2, "Second page prose.")] and pages[0].bbox
    n = index.counts()
    assert n["chunks"] == n["vectors"] == n["postings"]
    again, totals = ingest.ingest_folder(index, str(lib), recursive=True, max_bytes=4000, pdf_reader=reader)
    assert {r.outcome for r in again.filter("source_path = 'm.md'").collect()} == {"reused"} and totals.first().skipped == 4
    lib_ = Library(index)
    got = lib_.search_reply("ropes")
    assert got["hits"][0]["source_path"] in ("w.docx", "m.md") and got["processing_documents"] == []
    assert lib_.outline_reply(docs["w.docx"].document_id)["entries"][0]["title"] == "Top"
    failed = lib_.outline_reply(docs["page.txt"].document_id)
    assert failed["ingest_status"] == "failed" and failed["entries"] == []
    rows = lib_.ingest(files(spark, ("m.md", METHODS), ("new.md", "# New\n\nFresh.")))
    assert {(r.source_path, r.outcome, r.reused, r.status) for r in rows.collect()} == {("m.md", "reused", True, "ready"), ("new.md", "started", False, "ready")}


def test_segments_are_never_rewritten(spark, index):
    import os

    ingest.ingest(index, files(spark, ("m.md", METHODS)), parse_text)
    before = {p for p, _, names in os.walk(index.root) for n in names if n.endswith(".parquet") and "segments" in p}
    ingest.ingest(index, files(spark, ("n.md", NOTES)), parse_text)
    lib = Library(index)
    lib.delete(lib.documents().filter("source_path = 'm.md'").first().document_id)
    after = {p for p, _, names in os.walk(index.root) for n in names if n.endswith(".parquet") and "segments" in p}
    assert before < after and len(index.meta()["segments"]) == 2
    assert index.counts() == {"documents": 1, "chunks": 1, "vectors": 1, "postings": 1}
    ingest.ingest(index, files(spark, ("m.md", METHODS)), parse_text)  # what was deleted can come back
    assert index.counts()["chunks"] == 5 and lib.index.check() is None
    index.compact()
    assert len(index.meta()["segments"]) == 1 and index.meta()["gone"] is None
    n = index.counts()
    assert n["chunks"] == n["vectors"] == n["postings"] == 5
    lib.refresh()
    assert lib.search("badgers").first().title == "n"
    index._pointer = lambda: None  # another writer was first
    with pytest.raises(Exception):
        index._point({})


def test_search_reads_the_stored_index(spark, index):
    ingest.ingest(index, files(spark, ("m.md", METHODS), ("n.md", NOTES)), parse_text)
    lib = Library(index)
    plan = lib.search("badgers", mode="lexical")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan.lower() or "text#" not in plan.split("regexp_extract_all")[1][:60]


def test_several_models_are_refused(spark, index):
    ingest.ingest(index, files(spark, ("n.md", NOTES)), parse_text)
    mixed = index.read()["documents"].withColumn("embedding_model", F.lit("another"))
    index.publish(mixed)
    with pytest.raises(ingest.IndexMismatch):
        index.check()


def test_commands(spark, tmp_path):
    import json

    from quire import cli

    lib, questions = tmp_path / "lib", tmp_path / "q.json"
    lib.mkdir()
    (lib / "m.md").write_text(METHODS)
    (lib / "n.md").write_text(NOTES)
    code, lines = cli.ingest_command(spark, [f"--library={lib}", f"--index={tmp_path}/index", "--recursive"], {})
    assert code == 0 and lines == ["2 indexed, 0 already present, 0 failed", "index: 5 chunks / 5 full text / 5 vectors (in agreement)"]
    (lib / "bad.docx").write_bytes(b"PK broken")
    assert cli.ingest_command(spark, [f"--library={lib}", f"--index={tmp_path}/index"], {})[0] == 1
    ask = [{"id": "a", "question": "Where do badgers walk?", "type": "prose", "accept": [{"source_path": "n.md", "anchor": "badgers walk"}]}, {"id": "b", "question": "load in kg", "type": "table", "accept": [{"source_path": "m.md", "anchor": "| one | 3 |"}]}, {"id": "c", "question": "nothing", "type": "prose", "accept": [{"source_path": "m.md", "anchor": "not there"}]}]
    questions.write_text(json.dumps({"corpus": "c", "questions": ask}))
    out = cli.evaluate_command(spark, [f"--index={tmp_path}/index", f"--questions={questions}", "--json", "--sweep"])
    rows = [json.loads(x) for x in out]
    modes = {r["mode"]: r for r in rows if "mode" in r and "qtype" not in r}
    assert modes.keys() == {"lexical", "semantic", "hybrid"} and modes["hybrid"]["recall_1"] == 1.0 and modes["hybrid"]["questions"] == 2
    assert sum("fusion_k" in r for r in rows) == 24 and [r["reason"] for r in rows if "reason" in r] == ["anchor not found"]
    with pytest.raises(ToolError):
        cli.evaluate_command(spark, [f"--index={tmp_path}/index"])
