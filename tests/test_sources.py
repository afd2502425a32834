import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.sources import files, markup, paths, pdf, route


def kinds(blocks):
    return [(b.kind, b.text) for b in blocks]


def test_markdown_blocks_are_slices():
    source = "---\ntitle: \"Field notes\"\n---\n# Top *head*\n\nProse with [link](x).\nMore.\n\n## Second ##\n\n- one\n- two\n  more\n\n| a | b |\n| - | - |\n| 1 | 2 |\n\n```py\ncode # not a head\n```\n\n> quoted\nlazy\n\n***\n\n<div>dropped</div>\n\nUnder\n=====\n\nlast"
    blocks = list(markup.markdown_blocks(source))
    assert kinds(blocks) == [("heading", "# Top *head*"), ("paragraph", "Prose with [link](x).\nMore."), ("heading", "## Second ##"), ("list", "- one\n- two\n  more"), ("table", "| a | b |\n| - | - |\n| 1 | 2 |"), ("code", "```py\ncode # not a head\n```"), ("quote", "> quoted\nlazy"), ("heading", "Under\n====="), ("paragraph", "last")]
    assert all(b.text in source for b in blocks)
    assert blocks[2].path == ["Top head"] and blocks[3].path == ["Top head", "Second"] and blocks[-1].path == ["Under"]
    assert [b.locator for b in blocks] == ["sec-1"] * 2 + ["sec-2"] * 5 + ["sec-3"] * 2
    assert markup.markdown_metadata(source, "x.md") == ("Field notes", 2)
    assert markup.markdown_metadata("no heads", "x.md") == ("x.md", 1)
    assert list(markup.markdown_blocks("")) == []


def test_text_headings_in_order_of_rules():
    cases = [("", None, None), ("x" * 91, None, None), ("- item", "", None), ("1. Intro", "", 1), ("1. item", "2. item", None), ("3.2 Loads", "text", 2), ("3.2 Ends here.", "text", None), ("Title", "=====", 1), ("Title", "---", 2), ("Chapter 4 on", "x", 1), ("ALL CAPS", "x", 2), ("ALL CAPS!", "x", None), ("plain line", "x", None)]
    assert [markup.heading_level(a, b) for a, b, _ in cases] == [c for _, _, c in cases]


def test_text_blocks():
    source = "ROPES\n\nFirst line\nsecond line\n\n- a\n- b\ncontinued\n\nSub\n---\nBody"
    assert kinds(markup.text_blocks(source)) == [("heading", "ROPES"), ("paragraph", "First line\nsecond line"), ("list", "- a\n- b\ncontinued"), ("heading", "Sub"), ("paragraph", "Body")]
    assert kinds(markup.text_blocks("one \x0ctwo  \r\nthree")) == [("paragraph", "one \x0ctwo  \nthree")]  # a form feed ends no line
    assert markup.text_metadata(source, "n")[0] == "ROPES" and markup.text_metadata("", "n") == ("n", 1)


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body, notes="", title=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if notes:
            z.writestr("word/footnotes.xml", f"<w:footnotes {W}>{notes}</w:footnotes>")
        if title:
            z.writestr("docProps/core.xml", f'<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>{title}</dc:title></cp:coreProperties>')
    return out.getvalue()


def para(text, style=None, level=None, extra=""):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{level}"/></w:numPr>' if level is not None else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t>{extra}</w:r></w:p>"


def test_docx():
    note = '<w:footnoteReference w:id="2"/>'
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in (("a", "b|c"), ("1", "2"), ("", ""))) + "</w:tbl>"
    content = docx(para("Top", "Heading1") + para("Body  text", extra=note) + para("one", level=0) + para("two", level=1) + para("Wise", "Quote") + table, '<w:footnote w:id="0" w:type="separator"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>Note</w:t></w:r></w:p></w:footnote>')
    assert kinds(markup.docx_blocks(content)) == [("heading", "# Top"), ("paragraph", "Body text"), ("caption", "[footnote 1] Note"), ("list", "- one\n  - two"), ("quote", "> Wise"), ("table", "| a | b\\|c |\n| --- | --- |\n| 1 | 2 |")]
    assert markup.docx_metadata(content, "f.docx") == ("Top", 1)
    assert markup.docx_metadata(docx(para("x"), title="Named"), "f.docx") == ("Named", 1)
    with pytest.raises(ValueError):
        list(markup.docx_blocks(docx("")))


def test_lines_as_a_document():
    text = "One line\n\n  two\x0b <b> & more \n三"
    assert [b.text for b in markup.docx_blocks(markup.as_docx(text))] == ["One line", "two <b> & more", "三"]


def test_zip_limits():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.xml", b"x" * 1000)
        z.writestr("b.xml", b"y" * 1000)
    assert set(files.open_zip(out.getvalue(), lambda n, s: n == "a.xml")) == {"a.xml"}
    with pytest.raises(files.ArchiveTooLarge):
        files.open_zip(out.getvalue(), entry=999)
    with pytest.raises(files.ArchiveTooLarge):
        files.open_zip(out.getvalue(), archive=1500)


def test_paths(tmp_path, spark):
    root = str(tmp_path / "lib")
    os.makedirs(root + "/sub")
    assert paths.resolve(root, "sub/a.md") == root + "/sub/a.md"
    bad = ["", "  ", "a\0.md", ".", "../lib2/a.md", "sub/../../x.md", "/etc/passwd.md", "a.exe", "noext"]
    for p in bad:
        with pytest.raises(paths.PathRefused):
            paths.resolve(root, p)
    df = spark.createDataFrame([(p,) for p in [*bad, "sub/a.md", "sub/../b.TXT"]], "p string")
    assert [r.ok for r in df.select(paths.addressable(F.col("p")).alias("ok")).collect()] == [False] * len(bad) + [True] * 2
    os.symlink("/etc", root + "/out")
    with pytest.raises(paths.PathRefused):
        paths.real_inside(root, root + "/out/hosts")
    assert paths.real_inside(root, root + "/missing.md") == root + "/missing.md"
    assert paths.library_relative(root, root + "/sub/a.md") == "sub/a.md"


def test_library_walk(tmp_path, spark):
    for name, data in (("a.md", b"# A"), ("b.TXT", b"t"), (".hidden.md", b"x"), ("c.exe", b"x"), ("big.txt", b"z" * 100), ("sub/d.md", b"d")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    ok, refused = files.library(spark, str(tmp_path), max_bytes=50)
    assert sorted(r.path.rsplit("/", 1)[-1] for r in ok.collect()) == ["a.md", "b.TXT"]
    assert [r.length for r in refused.collect()] == [100]
    deep, _ = files.library(spark, str(tmp_path), recursive=True, max_bytes=50)
    assert deep.count() == 3
    assert files.decode(b"\xef\xbb\xbfok\xff") == "ok�"


def test_sniff_and_route(spark):
    word, slides, both = docx(para("x")), io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(slides, "w") as z:
        z.writestr("ppt/a.xml", "x")
    with zipfile.ZipFile(both, "w") as z:
        z.writestr("ppt/a.xml", "x")
        z.writestr("word/a.xml", "x")
    rows = [("a.bin", b"%PDF-1.7"), ("b.docx", word), ("c.zip", slides.getvalue()), ("d.docx", both.getvalue()), ("e.epub", b"PK\3\4" + b"\0" * 26 + b"mimetypeapplication/epub+zip"), ("f.doc", bytes.fromhex("d0cf11e0a1b11ae1")), ("g.txt", b"a\0b"), ("h.txt", b"  <!DOCTYPE HTML>"), ("i.htm", b"plain"), ("j.markdown", b"x"), ("k", b"---\ntitle: x\n"), ("l.txt", b"words"), ("m.txt", b""), ("n.docx", b"PKbroken")]
    got = {r.path: (r.format, r.refusal is not None) for r in route.route(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a.bin": "pdf", "b.docx": "docx", "c.zip": "pptx", "d.docx": "docx", "e.epub": "epub", "f.doc": "ole", "g.txt": "binary", "h.txt": "html", "i.htm": "html", "j.markdown": "md", "k": "md", "l.txt": "txt", "m.txt": "txt", "n.docx": "docx"}
    assert {k for k, v in got.items() if v[1]} == {"c.zip", "e.epub", "f.doc", "g.txt", "h.txt", "i.htm"}


#: Titles and what is left of them.
TITLES = {
    "  Good title ": "Good title", "": None, None: None, "Microsoft Word - thing": None, "Microsoft Word – report": None, "file.docx": None, "Untitled 1": None,
    "Layout1.indd": None, "Document": None, "Presentación de PowerPoint": None, "Apresentação do PowerPoint": None, "PowerPoint-Präsentation": None, "Slide 1": None,
    "PowerPoint for Beginners": "PowerPoint for Beginners", "Final draft": "Final draft", "The Copy of 2": "The Copy of 2", "Radar mast": "Radar mast", "Sin título": None, "12": None,
}


def test_route_by_probe(spark):
    rows = [(n, b"%PDF-1.7") for n in ("scan.pdf", "bad.pdf", "good.pdf", "unknown.pdf")] + [("a.md", b"# x")]
    files_ = spark.createDataFrame(rows, "path string, content binary")
    probes = spark.createDataFrame([("scan.pdf", True, False), ("bad.pdf", False, True), ("good.pdf", False, False)], "path string, image_only boolean, garbled boolean")
    got = {r.path: (r.engine, r.force_ocr, r.refusal) for r in route.route(files_, True, probes).collect()}
    assert got == {"scan.pdf": ("ts-ocr", False, None), "bad.pdf": ("ts-ocr", True, None), "good.pdf": ("ts-fast", False, None), "unknown.pdf": ("ts-fast", False, None), "a.md": ("ts-fast", False, None)}
    off = {r.path: (r.engine, r.refusal is not None) for r in route.route(files_, False, probes).collect()}
    assert off["scan.pdf"] == (None, True) and off["bad.pdf"] == (None, True) and off["good.pdf"] == ("ts-fast", False)


def test_titles_pages_and_layers(spark):
    t = spark.createDataFrame([(x,) for x in TITLES], "t string")
    assert [r[0] for r in t.select(route.usable_title(F.col("t"))).collect()] == list(TITLES.values())
    n = spark.createDataFrame([(x,) for x in (0, 1, 2, 5, 100, 1000)], "n int")
    assert [r[0] for r in n.select(route.sample_pages(F.col("n"))).collect()] == [[], [1], [1, 2], [1, 2, 4, 5], [1, 34, 67, 100], [1, 126, 251, 376, 501, 626, 751, 876, 1000]]
    lines = ["12", "12345", "Page 4", "iv", "XII", "I", "i", "iiii", "MIX", "Iv", "", "text", "12.", " iv. ", "Page  7", "mmmm", "I.", "page 3 of 4", "civil", "\u00a05\u00a0"]
    df = spark.createDataFrame([(x,) for x in lines], "l string")
    want = [True, False, True, True, True, False, True, False, True, False, False, False, True, True, True, True, False, False, False, True]
    assert [r[0] for r in df.select(route.page_number_line(F.col("l"))).collect()] == want
    assert [pdf.is_page_number(x) for x in lines] == want
    texts = spark.createDataFrame([("plain words here",), ("/g12/g13/g14 x",), ("��ab",), ("\x01\x02\x03a",)], "t string")
    assert [r[0] for r in texts.select(route.usable_text_layer(F.col("t"))).collect()] == [True, False, False, False]


def test_probe(spark):
    rows = [("scan", None, True), ("scan", "", True), ("text", "A page with enough text on it.", False), ("bad", "/g1/g2/g3/g4/g5/g6/g7/g8/g9", False), ("empty", None, False)]
    got = {r.document_id: (r.image_only, r.garbled, r.engine) for r in route.probe(spark.createDataFrame(rows, "document_id string, text string, has_image boolean")).collect()}
    assert got == {"scan": (True, False, "ts-ocr"), "text": (False, False, "ts-fast"), "bad": (False, True, "ts-ocr"), "empty": (False, False, "ts-fast")}


def test_manifest(spark):
    m = spark.createDataFrame([("a", "AA"), ("b", "bb"), ("c", "cc")], "file string, sha256 string")
    have = spark.createDataFrame([("a", "aa"), ("b", "xx"), ("d", "dd")], "file string, sha256 string")
    assert {tuple(r) for r in files.verify_manifest(m, have).collect()} == {("a", "OK"), ("b", "ALTERED"), ("c", "MISSING"), ("d", "UNLISTED")}


def run(text, x, y, size=11.0, **k):
    return pdf.Run(text, x, y, len(text) * size * 0.5, size, **k)


def test_pdf_lines_and_columns():
    page = [run("Full width heading over everything in the page here ok", 50, 700, 18)]
    for n in range(5):
        page += [run(f"left line {n} of the column", 50, 660 - 14 * n), run(f"right line {n} of the column", 320, 660 - 14 * n)]
    page.append(run("rotated", 20, 300, a=0.0, b=1.0))
    lines = [x.text for x in pdf.assemble_lines(page)]
    assert lines[0].startswith("Full width") and lines[1:6] == [f"left line {n} of the column" for n in range(5)] and lines[6:] == [f"right line {n} of the column" for n in range(5)]
    assert [x.text for x in pdf.assemble_lines([run("two", 100, 50), run("one", 50, 51)])] == ["one two"]
    assert pdf.assemble_lines([]) == []
    # a run belongs to the column its middle is in, wherever it begins
    hanging = [pdf.Run(f"left {n}", 50, 600 - 14 * n, 200, 11) for n in range(4)] + [pdf.Run(f"right {n}", 300 if n else 290, 600 - 14 * n, 200, 11) for n in range(4)]
    assert [x.text for x in pdf.assemble_lines(hanging)] == [f"left {n}" for n in range(4)] + [f"right {n}" for n in range(4)]


def test_pdf_blocks_drop_furniture_and_follow_bookmarks():
    pages = []
    for n in range(4):
        pages.append([run("Running Header", 50, 750), run(f"Section {n}", 50, 700, 20), run("This paragraph is hyphen-", 50, 660), run("ated on the page and goes on.", 50, 646), run(str(n + 1), 300, 30)])
    blocks = list(pdf.pdf_blocks(pages, bookmarks=[("Part", 2, 0), ("Broken", None, 0)]))
    assert [b.text for b in blocks if b.kind == "heading"] == [f"Section {n}" for n in range(4)]
    body = [b for b in blocks if b.kind == "paragraph"]
    assert body[0].text == "This paragraph is hyphenated on the page and goes on." and body[0].path == ["Section 0"]
    assert body[2].path == ["Part", "Section 2"] and body[0].locator == "1"
    assert all(0 <= v <= 1 for v in body[0].bbox)
    assert pdf.bookmark_trails([("A", 0, 0), ("B", 1, 1), ("C", 1, 1)]) == {0: ["A"], 1: ["A", "B"]}


def make_pdf(contents, title="A made file", extra="", compress=True, images=()):
    """A PDF with a page for every content stream, in Helvetica; page k of ``images`` paints one."""
    import zlib

    objects = ["<< /Type /Catalog /Pages 2 0 R /Outlines 90 0 R >>", "<< /Type /Pages /Count %d /Kids [%s] >>" % (len(contents), " ".join(f"{10 + 2 * k} 0 R" for k in range(len(contents)))), "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [%s] >>" % " ".join(["500"] * 200), f"<< /Title ({title}) >>"]
    out = b"%PDF-1.7\n" + b"".join(b"%d 0 obj %s endobj\n" % (n, o.encode("latin-1")) for n, o in enumerate(objects, 1))
    for k, c in enumerate(contents):
        raw = c.encode("cp1252")
        raw = zlib.compress(raw) if compress else raw
        out += b"%d 0 obj << /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> /XObject << /Im 80 0 R >> >> /Contents %d 0 R >> endobj\n" % (10 + 2 * k, 11 + 2 * k)
        out += b"%d 0 obj << /Length %d %s >> stream\n" % (11 + 2 * k, len(raw), b"/Filter /FlateDecode" if compress else b"") + raw + b"\nendstream endobj\n"
    out += b"80 0 obj << /Type /XObject /Subtype /Image /Length 0 >> stream\n\nendstream endobj\n"
    return out + extra.encode("latin-1") + b"trailer << /Root 1 0 R /Info 4 0 R >>\n%%EOF"


def test_pdf_bytes():
    from quire.plans.ingest import parse_file
    from quire.sources.pdf_bytes import UnreadablePdf, read_pdf

    one = "BT /F1 20 Tf 50 700 Td (Loads) Tj ET BT /F1 11 Tf 50 660 Td (The rope is hyphen-) Tj 0 -14 Td [(ated) -600 (and ) (held \\(well\\)\\056)] TJ ET BT /F1 11 Tf 300 30 Td (1) Tj ET"
    two = "q 1 0 0 1 0 10 cm BT /F1 11 Tf 1 0 0 1 50 650 Tm 14 TL (Caf\\351 and t\xe9) Tj T* (second line) Tj <2041> Tj ET Q BT 0 1 -1 0 20 300 Tm /F1 9 Tf (sideways) Tj ET"
    marks = "90 0 obj << /First 91 0 R >> endobj 91 0 obj << /Title (Part one) /Dest [12 0 R /Fit] >> endobj\n"
    for compress in (True, False):
        got = read_pdf(make_pdf([one, two], extra=marks, compress=compress))
        assert got["title"] == "A made file" and got["bookmarks"] == [("Part one", 1, 0)] and got["images"] == [False, False]
        assert [x.text for x in pdf.assemble_lines(got["pages"][0])] == ["Loads", "The rope is hyphen-", "ated and held (well).", "1"]
        assert [x.text for x in pdf.assemble_lines(got["pages"][1])] == ["Café and té", "second line A"]
    title, scheme, n, blocks = parse_file("pdf", "x.pdf", make_pdf([one, two], title="Microsoft Word - x", extra=marks))
    assert (title, scheme, n) == (None, "page", 2)
    assert [(b.kind, b.text, b.locator) for b in blocks] == [("heading", "Loads", "1"), ("paragraph", "The rope is hyphenated and held (well).", "1"), ("paragraph", "Café and té second line A", "2")]
    assert blocks[2].path == ["Part one"]
    with pytest.raises(ValueError, match="images"):
        parse_file("pdf", "x.pdf", make_pdf(["q /Im Do Q"] * 3))
    for bad in (b"%PDF-1.4 nothing", b"no", make_pdf([one]).replace(b"/Info", b"/Encrypt 5 0 R /Info")):
        with pytest.raises(UnreadablePdf):
            read_pdf(bad)


def test_pdf_fonts_with_maps():
    from quire.sources.pdf_bytes import Document, Font

    cmap = "2 beginbfchar <0003> <0020> <0041> <00E9> endbfchar 1 beginbfrange <0050> <0052> <0061> endbfrange"
    data = f"%PDF-1.5\n1 0 obj << /Type /Catalog >> endobj 5 0 obj << /Subtype /Type0 /ToUnicode 6 0 R /DescendantFonts [7 0 R] >> endobj 6 0 obj << /Length {len(cmap)} >> stream\n{cmap}\nendstream endobj 7 0 obj << /DW 900 /W [65 [700] 80 82 300] >> endobj trailer << /Root 1 0 R >>".encode()
    font = Font(d := Document(data), d.get(d.objects[5]))
    codes = font.codes(bytes.fromhex("004100500052"))
    assert "".join(font.char(c) for c in codes) == "éac" and [font.widths.get(c, font.default) for c in codes] == [700, 300, 300]


def test_scanned_pages_vote():
    pages = [{"text": "A text layer that is long enough to be used as it is here.", "usable": True}, {"text": "short", "lines": [("recognised line", 90), ("noise", 10), ("12", 95)], "trail": ["Ch"]}, {"text": "", "lines": []}]
    blocks = list(pdf.scanned_blocks(pages))
    assert [(b.text, b.locator, b.path) for b in blocks] == [("A text layer that is long enough to be used as it is here.", "1", []), ("recognised line", "2", ["Ch"])]
    assert next(iter(pdf.scanned_blocks(pages[:1], force=True)), None) is None
