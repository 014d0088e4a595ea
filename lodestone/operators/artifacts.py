"""Artifacts of parsed files, from which blocks are rebuilt without parsing the file again.

Office files and locally read PDF files leave their blocks as an HTML document; PDF files of a layout reader leave cleaned
markdown with the reader's elements, their pages and boxes, as JSON; PDF files of a markdown reader leave that markdown.
An HTML artifact made here keeps white space and the rule line of tables, so that reading it gives equal blocks.
"""

from __future__ import annotations

import html
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import bounded
from ..sources.readers import reusable, write_artifacts
from . import layout, parsing

#: Names of artifacts that stand for a file, by extension and PDF reader (fixed values).
NAMES = {"pdf:local": "pdf.unstructured.extracted.html", "pdf:opendataloader": "opendataloader.json", "pdf:llamaparse": "llamaparse.cleaned.md", "xlsx": "xlsx.extracted.html", "docx": "docx.extracted.html", "pptx": "pptx.extracted.html"}
_TYPES = {"html": "text/html; charset=utf-8", "json": "application/json; charset=utf-8", "md": "text/markdown; charset=utf-8"}
#: Version of the JSON artifact's layout.
SCHEMA = "layout-v1"
#: Marks HTML whose white space counts.
_EXACT = "data-exact"

_ARTIFACT = "document_id long, file_name string, artifact_name string, content_type string, payload binary, error string"
_REBUILT = parsing._BLOCKS.replace(", error string", "") + ", page_start int, page_end int, regions array<struct<page:int,left:double,bottom:double,right:double,top:double>>, error string"


def artifact_name(file_name: str, provider: str = "local") -> str | None:
    """The artifact that may stand for a file; None for files that are read directly."""
    extension = file_name.lower().rsplit(".", 1)[-1]
    return NAMES.get(f"pdf:{provider}" if extension == "pdf" else extension)


def write_html(blocks: list[parsing.Block]) -> str:
    """Blocks as one readable HTML document, a section for each run under one heading."""
    out, before = ["<html " + _EXACT + ">", "<body>"], None
    for b in blocks:
        here = (b.heading, b.level)
        if before is None or here != before:
            out += (["</section>"] if before is not None else []) + ["<section>"]
            if b.heading is not None:
                level = b.level if b.level in (1, 2, 3) else 1
                out.append(f"<h{level}>{html.escape(b.heading)}</h{level}>")
            else:
                out.append("<h1></h1>")  # no heading from here on
            before = here
        if b.kind == "table":
            lines = b.text.split("\n")
            row = lambda line, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in parsing.cells(line)) + "</tr>"
            out.append(f'<table data-rule="{html.escape(lines[1] if len(lines) > 1 else "")}">' + row(lines[0], "th") + "".join(row(x, "td") for x in lines[2:]) + "</table>")
        else:
            out.append(f"<p>{html.escape(b.text)}</p>")
    return "\n".join([*out, *(["</section>"] if before is not None else []), "</body>", "</html>"])


class _Exact(parsing._Collector):
    """Reads write_html(): white space counts, an empty heading ends the heading, tables keep their rule line."""

    rule = ""

    @staticmethod
    def squeezed(parts: list[str]) -> str:
        return "".join(parts).strip()

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.rule = dict(attrs).get("data-rule") or ""
        super().handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        empty = tag == self.open_heading and not self.squeezed(self.title)
        super().handle_endtag(tag)
        if empty:
            self.heading = self.level = None

    def end_table(self):
        n = len(self.out)
        super().end_table()
        if len(self.out) > n and self.rule:
            lines = self.out[-1].text.split("\n")
            self.out[-1].text = "\n".join([lines[0], self.rule, *lines[2:]])


def read_html(data: str) -> list[parsing.Block]:
    """Blocks of an HTML artifact; one that was not made here is read as any page."""
    if not data.startswith("<html " + _EXACT):
        return parsing.parse_html(data)
    c = _Exact()
    c.feed(data)
    c.close()
    return c.out


def write_json(markdown: str, payload: str | None) -> str:
    """Cleaned markdown and a layout reader's elements in reading order, their fields by one name each, keys sorted."""
    rows = []
    for e in layout.elements(payload):
        row: dict = {"type": "table" if e["table"] else "text", "text": e["text"]}
        row |= {k: e[n] for k, n in (("page_number", "page"), ("heading_level", "level")) if e[n] is not None}
        if e["boxes"]:
            row["regions"] = [{"page_number": b["page"], **{n: b[n] for n in layout._BOX}} for b in e["boxes"]]
        rows.append(row)
    return json.dumps({"schema_version": SCHEMA, "cleaned_markdown": markdown, "elements": rows}, ensure_ascii=False, sort_keys=True)


def read_json(data: str) -> tuple[list[parsing.Block], list[dict]]:
    """(blocks, elements) of a JSON artifact; without cleaned markdown it is an error."""
    got = json.loads(data)
    markdown = str(got.get("cleaned_markdown") or got.get("markdown") or "").strip() if isinstance(got, dict) else ""
    if not markdown:
        raise ValueError("the artifact has no cleaned_markdown")
    return parsing.parse_markdown(markdown, short_rules=True), layout.elements(data)


def make(files: DataFrame, provider: str = "local") -> DataFrame:
    """Artifact rows of files (document_id, file_name, content binary, payload: a layout reader's JSON, or null).

    Files that are read directly give no row; one that cannot be parsed gives a row with the error.
    """

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
        for batch in batches:
            rows: list[tuple] = []
            for doc, name, data, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept = artifact_name(name or "", provider)
                if kept is None:
                    continue
                end = kept.rsplit(".", 1)[-1]
                try:
                    if end == "html":
                        made = write_html([b for _, b, *_ in parsing.placed(parsing.PARSERS[name.lower().rsplit(".", 1)[-1]](data or b""))])
                    else:
                        text = (data or b"").decode("utf-8").strip()
                        made = write_json(text, payload) if end == "json" else text
                    rows.append((doc, name, kept, _TYPES[end], made.encode(), None))
                except parsing.UNREADABLE as e:
                    rows.append((doc, name, kept, _TYPES[end], None, str(e) or type(e).__name__))
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _ARTIFACT.split(", ")])

    return bounded(files.select(F.col("document_id").cast("long"), "file_name", "content", "payload")).mapInArrow(run, _ARTIFACT)


def rebuild(artifacts: DataFrame) -> DataFrame:
    """Block rows of artifacts (document_id, artifact_name, payload), with pages and boxes where the artifact has them.

    An artifact that cannot be read is one row with the error; its file is then parsed again by whoever has it.
    """

    def run(batches):
        box = pa.struct([("page", pa.int32()), *((n, pa.float64()) for n in layout._BOX)])
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(box), pa.string()]
        for batch in batches:
            rows: list[tuple] = []
            for doc, name, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    end = (name or "").rsplit(".", 1)[-1]
                    text, found = (payload or b"").decode("utf-8"), None
                    if end == "json":
                        blocks, found = read_json(text)
                    elif end in ("html", "md"):
                        blocks = read_html(text) if end == "html" else parsing.parse_markdown(text, short_rules=True)
                    else:
                        raise ValueError(f"no artifact of this kind: {name}")
                    held = list(parsing.placed(blocks))
                    own = layout.match([(b.kind, b.text) for _, b, *_ in held], found) if found else [[] for _ in held]
                    for (i, b, s, e), mine in zip(held, own, strict=True):
                        boxes = [x for m in mine for x in m["boxes"]]
                        pages = [x["page"] for x in boxes] or [int(m["page"]) for m in mine if m["page"] is not None]
                        rows.append((doc, i, b.kind, b.heading, b.level, b.text, s, e, min(pages, default=None), max(pages, default=None), boxes, None))
                except parsing.UNREADABLE as e:
                    rows.append((doc, 0, None, None, None, None, 0, 0, None, None, [], str(e) or type(e).__name__))
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _REBUILT.split(", ")])

    return bounded(artifacts.select(F.col("document_id").cast("long"), "artifact_name", "payload")).mapInArrow(run, _REBUILT)


def ingest(files: DataFrame, path: str, provider: str = "local") -> DataFrame:
    """Block rows of files (document_id, file_name, content, payload): of those with an artifact under path from it, of the
    others by parsing, whose artifacts are then written there. Files that leave no artifact are parsed each time."""
    spark = files.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    new = files
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        new, _ = reusable(files, spark.read.parquet(path))
    made = make(new, provider).where("error is null").drop("error")
    if not made.isEmpty():
        write_artifacts(made, path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return parsed(files)
    direct, kept = reusable(files, spark.read.parquet(path))
    return rebuild(kept).unionByName(parsed(direct))


def parsed(files: DataFrame) -> DataFrame:
    """parsing.parse_files() with the columns of rebuild()."""
    rows = parsing.parse_files(files)
    none = F.array().cast("array<struct<page:int,left:double,bottom:double,right:double,top:double>>")
    return rows.select(*rows.columns[:-1], F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), none.alias("regions"), "error")
