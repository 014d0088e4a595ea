import io
import json
import zipfile

from lodestone.operators import artifacts, parsing


def _docx():
    w = 'xmlns:w="w"'
    body = '<w:p><w:t>Lead &amp; more</w:t></w:p><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>T &lt;1&gt;</w:t></w:r></w:p><w:p><w:r><w:t>body  two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:t>1</w:t></w:p></w:tc></w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


MARKDOWN = "intro\nsecond  line\n\n# H & co\ntext <b>\n\n| a | b |\n|---|:---:|\n| 1 | x\\|y |\n## G\n\nend"


def test_html_round_trip():
    for blocks in (parsing.parse_markdown(MARKDOWN), parsing.parse_docx(_docx()), [], [parsing.Block("text", "a", "x", 1), parsing.Block("text", None, "y\n  z", None), parsing.Block("text", "a", "w", 3)]):
        assert artifacts.read_html(artifacts.write_html(blocks)) == blocks
    assert artifacts.read_html("<h1>T</h1><p>a  b</p>") == [parsing.Block("text", "T", "a b", 1)]


def test_names():
    assert [artifacts.artifact_name(f, p) for f, p in (("a.PDF", "local"), ("a.pdf", "opendataloader"), ("b.docx", "x"), ("c.md", "local"), ("d.pdf", "other"))] == ["pdf.unstructured.extracted.html", "opendataloader.json", "docx.extracted.html", None, None]


def test_all_pages_come_back(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("page_id AS document_id", "'p.html' AS file_name", "cast(html AS binary) AS content")
    direct = parsing.parse_files(pages).where("error is null")
    rows = {}
    for r in direct.orderBy("document_id", "block_index").collect():
        rows.setdefault(r.document_id, []).append(parsing.Block(r.block_kind, r.heading, r.content, r.heading_level))
    stored = spark.createDataFrame([(d, "p.extracted.html", bytearray(artifacts.write_html(b).encode())) for d, b in rows.items()], "document_id long, artifact_name string, payload binary")
    back = artifacts.rebuild(stored).select(*[c for c in direct.columns if c != "error"])
    assert len(rows) > 50
    assert sorted(map(str, back.collect())) == sorted(map(str, direct.drop("error").collect()))


def test_json_artifacts(spark):
    payload = json.dumps({"kids": [{"type": "Heading", "content": "H & co", "page": 1, "level": 2}, {"type": "paragraph", "text": "text <b>", "bbox": {"page": 2, "x0": 1, "y0": 2, "x1": 3, "y1": 4}}, {"type": "Table", "content": "a b 1", "page_number": 3}]})
    made = json.loads(artifacts.write_json("# H & co\ntext <b>", payload))
    assert list(made) == sorted(made) and made["elements"][1]["regions"] == [{"page_number": 2, "left": 1.0, "bottom": 2.0, "right": 3.0, "top": 4.0}]
    assert artifacts.read_json(json.dumps(made))[1] == artifacts.layout.elements(payload)
    files = spark.createDataFrame([(1, "a.pdf", bytearray(b"# H & co\ntext <b>"), payload), (2, "b.pdf", bytearray(b" "), "not json"), (3, "c.txt", bytearray(b"x"), None)], "document_id long, file_name string, content binary, payload string")
    rows = {r.document_id: r for r in artifacts.rebuild(artifacts.make(files, "opendataloader")).collect()}
    assert (rows[1].heading, rows[1].content, rows[1].page_start, rows[1].page_end, len(rows[1].regions)) == ("H & co", "text <b>", 2, 2, 1)
    assert rows[2].error == "the artifact has no cleaned_markdown" and 3 not in rows


def test_ingest_parses_once(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.docx", bytearray(_docx()), None), (2, "b.md", bytearray(MARKDOWN.encode()), None), (3, "c.docx", bytearray(b"broken"), None)], "document_id long, file_name string, content binary, payload string")
    path = f"{tmp_path}/artifacts"
    first = sorted(map(str, artifacts.ingest(files, path).collect()))
    assert first == sorted(map(str, artifacts.parsed(files).collect()))
    held = spark.read.parquet(path)
    assert [(r.document_id, r.artifact_name) for r in held.collect()] == [(1, "docx.extracted.html")]
    gone = files.selectExpr("document_id", "file_name", "if(document_id = 1, cast('gone' AS binary), content) AS content", "payload")
    assert sorted(map(str, artifacts.ingest(gone, path).collect())) == first
