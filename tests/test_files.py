import io
import json
import zipfile

from pyspark.sql import functions as F

from lectern.operators import markdown as M
from lectern.sources import delimited, export, files, markup, tables

DOC = (
    '<w:document><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title &amp; more</w:t></w:r></w:p>'
    '<w:p><w:pPr><w:pStyle w:val="ListNumber"/><w:numPr><w:ilvl w:val="0"/></w:numPr></w:pPr><w:r><w:t>one</w:t></w:r></w:p>'
    '<w:p><w:pPr><w:pStyle w:val="ListNumber"/><w:numPr><w:ilvl w:val="0"/></w:numPr></w:pPr><w:r><w:t>two</w:t></w:r></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>B|C</w:t></w:r></w:p></w:tc></w:tr>"
    "<w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Plain text.</w:t></w:r></w:p></w:body></w:document>"
)


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def test_file_scan_and_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "note.md").write_text("Hello\n\nHello there")
    (tmp_path / "pic.png").write_bytes(b"\x89PNG")
    scanned = files.scan_files(spark, str(tmp_path))
    assert {(r["name"], r["size"]) for r in scanned.collect()} == {("note.md", 18), ("pic.png", 4)}
    assert [r["text"] for r in files.text_files(scanned).collect()] == ["[File: note.md]\n\nHello\n\nHello there"]


def test_archive_members(spark, tmp_path):
    data = zipped({"a.txt": "alpha", "dir/b.md": "beta", "__MACOSX/c.txt": "no", ".git/d.txt": "no", "e.exe": "no"})
    (tmp_path / "x.zip").write_bytes(data)
    members = files.archive_members(files.scan_files(spark, str(tmp_path)))
    got = {r["member"]: r["section"] for r in files.archive_sections(members).collect()}
    assert got == {"a.txt": "# Archive file: a.txt\n\nalpha", "dir/b.md": "# Archive file: dir/b.md\n\nbeta"}


def test_word_and_slides(spark, tmp_path):
    (tmp_path / "d.docx").write_bytes(zipped({"word/document.xml": DOC}))
    para = lambda t, lvl: f'<a:p><a:pPr lvl="{lvl}"/><a:r><a:t>{t}</a:t></a:r></a:p>'
    deck = {f"ppt/slides/slide{n}.xml": para(f"Title {n}", 0) + para("point", 1) for n in (10, 2)}
    deck["ppt/slides/slide3.xml"] = "<p:sld/>"
    (tmp_path / "s.pptx").write_bytes(zipped(deck))
    scanned = files.scan_files(spark, str(tmp_path))
    word = files.word_text(files.package_parts(scanned.filter("name like '%docx'"), r"^word/document\.xml$")).first()["text"]
    assert word == "# Title & more\n\n1. one\n\n2. two\n\n| A | B\\|C |\n| --- | --- |\n| 1 |  |\n\nPlain text."
    deck_rows = files.slides(files.package_parts(scanned.filter("name like '%pptx'"), r"^ppt/slides/slide\d+\.xml$"))
    text = files.slide_deck_text(deck_rows).first()["text"]
    assert text == "<!-- SLIDE 1 -->\n\n# Title 2\n\n  - point\n\n<!-- SLIDE 3 -->\n\n# Title 10\n\n  - point"


def test_nested_json(spark):
    doc = json.dumps({"a": {"b": 1, "c": [1, {"d": None}]}, "e": True, "f": 2.0, "g": "x"})
    df = spark.createDataFrame([(doc,), ('{"k": 69}',)], "j string")
    got = [r["lines"] for r in markup.json_lines(df, "j").collect()]
    assert got == ["a:\na.b: 1\na.c:\n1\na.c[1].d: \ne: true\nf: 2\ng: x", "k: 69"]


def test_svg_text(spark):
    svg = '<svg><script>alert(1)</script><text onclick="x()">Safe Name</text><g><tspan><a href="javascript:1">Info</a></tspan></g></svg>'
    df = spark.createDataFrame([(svg,)], "s string")
    assert df.select(markup.svg_labels(F.col("s"))).first()[0] == "Safe Name\nInfo"


def test_delimited_round_trip(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\t\"x\"\"y\"\n")
    rows = delimited.read_delimited(spark, str(tmp_path / "t.tsv"), "a int, b string", "\t").collect()
    assert [tuple(r) for r in rows] == [(1, 'x"y')]


def test_legacy_store_is_idempotent(spark, tmp_path):
    store = {
        "docs": [{"id": "d1", "name": "a.pdf", "hash": "h", "uploadedAt": 1700000000000, "pageCount": 0}, {"documentId": "d2", "originalFilename": "b"}],
        "chunks": [{"docId": "d1", "text": "one"}, {"id": "own", "docId": "d1", "text": "two"}, {"docId": "gone", "text": "x"}],
    }
    (tmp_path / "kb.json").write_text(json.dumps(store))
    documents, versions, chunks = files.legacy_store(spark, str(tmp_path / "kb.json"))
    assert {(r["id"], r["extension"], r["size_bytes"]) for r in documents.collect()} == {("d1", "unknown", 0), ("d2", "unknown", 0)}
    assert documents.filter("id = 'd1'").first()["created_at"].year == 2023
    assert versions.filter("id = 'd1_v1'").first()["page_count"] is None
    assert {(r["id"], r["chunk_index"]) for r in chunks.collect()} == {("d1_v1_chunk_0", 0), ("own", 1)}
    path = str(tmp_path / "chunks")
    for _ in range(2):
        tables.append_absent(spark, path, chunks, ["id"])
    assert spark.read.parquet(path).count() == 2


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 1)], "doc_id int, content string, bucket int").write.partitionBy("bucket").parquet(path)
    before = {p.name for p in (tmp_path / "t" / "bucket=1").iterdir()}
    fresh = spark.createDataFrame([(1, "new1", 0), (1, "new2", 0)], "doc_id int, content string, bucket int")
    touched = spark.createDataFrame([(1, 0)], "doc_id int, bucket int")
    tables.replace_in_partitions(spark, path, fresh, touched, "doc_id", "bucket")
    assert {(r["doc_id"], r["content"]) for r in spark.read.parquet(path).collect()} == {(1, "new1"), (1, "new2"), (2, "b"), (3, "c")}
    assert {p.name for p in (tmp_path / "t" / "bucket=1").iterdir()} == before


REPORT = (
    "# Report\n\n## Analysis\n\nA paragraph with 7.30% and an em dash — kept.\n\n- First & item\n- Second item\n\n1. First step\n\n"
    "-\nloose bullet\n\n###\n\n| Metric | Result |\n| --- | --- |\n| Value | 21% |\n\n## Sources\n\n- a.pdf"
)


def report(spark):
    return M.blocks_of(spark.createDataFrame([(1, REPORT)], "doc_id int, text string"))


def test_blocks(spark):
    got = [(r["type"], r["text"]) for r in report(spark).orderBy("pos").collect()]
    assert got == [
        ("h1", "Report"), ("h2", "Analysis"), ("p", "A paragraph with 7.30% and an em dash — kept."), ("bullet", "First & item"),
        ("bullet", "Second item"), ("numbered", "First step"), ("bullet", "loose bullet"), ("table", None), ("h2", "Sources"), ("bullet", "a.pdf"),
    ]
    assert report(spark).filter("type = 'table'").first()["rows"] == [["Metric", "Result"], ["Value", "21%"]]


def test_structured_document(spark):
    sources = spark.createDataFrame([(1, "a.pdf")], "doc_id int, name string")
    rows = M.structured_documents(report(spark), sources).collect()
    assert {r["title"] for r in rows} == {"Report"}
    assert "Sources" not in {r["heading"] for r in rows}
    assert any(r["node"] == "table" for r in rows)
    wide = M.blocks_of(spark.createDataFrame([(1, "| A | B | C | D | E | F |\n| - | - | - | - | - | - |\n| One | Two | Three | Four | Five | Six |")], "doc_id int, text string"))
    assert M.structured_documents(wide).first()["rows"][-1] == ["One", "Two", "Three", "Four", "Five", "Six"]


def test_exports(spark, tmp_path):
    rows = export.delimited_rows(report(spark)).orderBy("pos", "row").select(export.csv_line(F.col("cells")), export.tsv_line(F.col("cells"))).collect()
    assert [tuple(r) for r in rows] == [('"Metric","Result"', "Metric\tResult"), ('"Value","21%"', "Value\t21%")]
    plain = M.blocks_of(spark.createDataFrame([(2, '# T\n\n- say "x"')], "doc_id int, text string"))
    lines = [r[0] for r in export.delimited_rows(plain).orderBy("pos").select(export.csv_line(F.col("cells"))).collect()]
    assert lines == ['"Type","Content"', '"h1","T"', '"bullet","say ""x"""']
    doc = json.loads(export.json_documents(report(spark)).first()["json"])
    assert doc["title"] == "Report" and [s["heading"] for s in doc["sections"]] == ["Analysis", "Sources"]
    assert doc["sections"][0]["content"][1] == {"type": "bullet", "text": "First & item"}
    html = export.html_documents(report(spark)).first()["html"]
    assert "<ul>\n<li>First &amp; item</li>\n<li>Second item</li>\n</ul>" in html
    assert "<tr><th>Metric</th><th>Result</th></tr><tr><td>Value</td><td>21%</td></tr>" in html
    export.write_texts(export.html_documents(report(spark)), "html", str(tmp_path / "html"))
    export.write_delimited(export.delimited_rows(report(spark)), str(tmp_path / "csv"))
    assert (tmp_path / "csv" / "doc_id=1").is_dir()


def test_file_checks(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.json").write_text('{"a": 1}')
    (tmp_path / "d.txt").write_bytes(b"")
    names = spark.createDataFrame([("a.pdf",), ("b.docx",), ("c.json",), ("d.txt",)], "name string")
    got = {r["name"]: r["ok"] for r in export.file_checks(spark, str(tmp_path), names).collect()}
    assert got == {"a.pdf": True, "b.docx": False, "c.json": True, "d.txt": False}


def _report(spark):
    texts = [(1, "# Title\n## One\ntext\n- point"), (2, "# T\n| a | 1 |\n| b | 2 |\nend"), (3, ""), (4, "plain")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    return M.blocks_of(docs)


def _reads(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Generate posexplode(filter(")


def test_csv_rows_read_the_blocks_once(spark):
    rows = export.delimited_rows(_report(spark))
    assert _reads(rows) == 1
    got = sorted((r["doc_id"], r["pos"], r["row"], *r["cells"]) for r in rows.collect())
    assert [(d, *cells) for d, _, _, *cells in got] == [
        (1, "Type", "Content"), (1, "h1", "Title"), (1, "h2", "One"), (1, "p", "text"), (1, "bullet", "point"),
        (2, "a", "1"), (2, "b", "2"), (4, "Type", "Content"), (4, "p", "plain"),
    ]


def test_structured_documents_read_the_blocks_once(spark):
    rows = M.structured_documents(_report(spark))
    assert _reads(rows) == 1
    got = sorted((r["doc_id"], r["title"], r["heading"] or "", r["pos"], r["node"], r["text"]) for r in rows.collect() if r["node"] != "table")
    assert got == [
        (1, "Title", "One", 1, "heading", "One"), (1, "Title", "One", 2, "paragraph", "text"), (1, "Title", "One", 3, "bullet", "point"),
        (2, "T", "", 2, "paragraph", "end"), (4, "Report", "", 0, "paragraph", "plain"),
    ]


def test_archives_reach_python_in_bounded_batches(spark):
    conf = {f"spark.sql.execution.arrow.{n}": spark.conf.get(f"spark.sql.execution.arrow.{n}") for n in ("maxRecordsPerBatch", "maxBytesPerBatch")}
    try:
        for name in conf:
            spark.conf.set(name, "100000000")
        rows = [(f"p{i}", zipped({"a.txt": f"text {i}", "b.exe": "x"})) for i in range(2500)] + [("bad", b"no zip")]
        packed = spark.createDataFrame(rows, "path string, bytes binary").coalesce(1)
        got = files.archive_members(packed).collect()
        assert [(r["path"], r["member"], r["raw"]) for r in got[:2500]] == [(f"p{i}", "a.txt", f"text {i}") for i in range(2500)]
        assert got[2500]["path"] == "bad" and got[2500]["error"] and len(got) == 2501
        assert all(int(spark.conf.get(n).rstrip("b")) <= 4 << 20 for n in conf)
    finally:
        for name, value in conf.items():
            spark.conf.set(name, value)


def test_a_file_is_read_once_whatever_its_kind(spark, tmp_path):
    import io
    import zipfile

    from lectern.sources.files import extracted_texts, file_texts

    def package(parts):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, body in parts.items():
                z.writestr(name, body)
        return data.getvalue()

    slide = "<a:p><a:r><a:t>{}</a:t></a:r></a:p>"
    files = {
        "a.txt": b"  plain\n\n\n\ntext ", "b.html": b"<p>first</p>", "c.json": b'{"k": {"n": 1}}', "flat.json": b'{"k": 76}',
        "d.yaml": b"k: [1, 2]", "e.svg": b"<svg><text>label</text></svg>", "f.bin": b"\xff", "empty.txt": b" ",
        "z.zip": package({"b.txt": "second", "a.md": "first", "no.exe": "x"}), "bad.docx": b"PK\x03\x04",
        "s.pptx": package({"ppt/slides/slide10.xml": slide.format("ten"), "ppt/slides/slide2.xml": slide.format("two"), "ppt/slides/slide3.xml": ""}),
    }
    rows = [(n, n, bytearray(d)) for n, d in files.items()]
    spark.createDataFrame(rows, "doc_id string, name string, bytes binary").write.parquet(str(tmp_path / "files"))
    stored = spark.read.parquet(str(tmp_path / "files"))
    plan = extracted_texts(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan and "Aggregate" not in plan
    text = {r["doc_id"]: r["text"] for r in file_texts(stored).collect()}
    assert set(text) == set(files)
    body = {n: t and t.removeprefix(f"[File: {n}]\n\n") for n, t in text.items()}
    assert body["a.txt"] == "plain\n\ntext" and body["flat.json"] == "k: 76" and "first" in body["b.html"] and "n: 1" in body["c.json"]
    assert body["e.svg"] == "label" and body["z.zip"] == "# Archive file: a.md\n\nfirst\n\n# Archive file: b.txt\n\nsecond"
    assert body["s.pptx"] == "<!-- SLIDE 1 -->\n\n# two\n\n<!-- SLIDE 3 -->\n\n# ten" and "1" in body["d.yaml"]
    assert {n for n, t in text.items() if t is None} == {"f.bin", "bad.docx", "empty.txt"}
