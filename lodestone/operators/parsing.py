"""Parsers: file contents to ordered blocks (kind, heading, level, text), as row functions over Arrow batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import bounded


@dataclass
class Block:
    """One piece of a parsed file."""

    kind: str
    heading: str | None
    text: str
    level: int | None = None


_HEADING = re.compile(r"^(#{1,3})\s+(.+)$")
_RULE = re.compile(r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*$")
_SHORT_RULE = re.compile(r"^\s*\|?\s*:?\s*-+\s*:?\s*(\|\s*:?\s*-+\s*:?\s*)*\|?\s*$")
_BAR = re.compile(r"(?<!\\)\|")


def cells(line: str) -> list[str]:
    """Cells of a table row; an escaped bar is part of its cell."""
    bare = line.strip().removeprefix("|")
    bare = bare[:-1] if bare.endswith("|") and not bare.endswith("\\|") else bare
    return [c.strip() for c in _BAR.split(bare)] if bare else []


def render(rows: list[list[str]], align: list[str] | None = None) -> str:
    """Rows as a table: the first is the header, all padded to the widest; blank rows fall away."""
    rows = [r for r in rows if any(c.strip() for c in r)]
    if not rows:
        return ""
    width = max(len(r) for r in [*rows, align or []])
    marks = [m.replace(" ", "") for m in (align or [])] + [""] * (width - len(align or []))
    rule = [(":" if m.startswith(":") else "") + "---" + (":" if m.endswith(":") else "") for m in marks]
    line = lambda r: "| " + " | ".join([*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), line(rule), *map(line, rows[1:])])


def parse_text(data: str) -> list[Block]:
    return [Block("text", None, data.strip())] if data.strip() else []


def parse_markdown(data: str, short_rules: bool = False) -> list[Block]:
    """Headings of one to three marks start blocks; a row with a bar over a rule line starts a table that runs to a
    blank line or one without a bar. short_rules also takes single hyphens as a rule."""
    out: list[Block] = []
    heading, level, held = None, None, []
    lines = [x.rstrip() for x in data.splitlines()]
    rule = _SHORT_RULE if short_rules else _RULE

    def flush() -> None:
        if text := "\n".join(held).strip():
            out.append(Block("text", heading, text, level))
        held.clear()

    i = 0
    while i < len(lines):
        if m := _HEADING.match(lines[i]):
            flush()
            heading, level = m.group(2).strip(), len(m.group(1))
        elif "|" in lines[i] and i + 1 < len(lines) and "-" in lines[i + 1] and rule.match(lines[i + 1]):
            flush()
            end = i + 2
            while end < len(lines) and "|" in lines[end]:
                end += 1
            out.append(Block("table", heading, render([cells(x) for x in (lines[i], *lines[i + 2 : end])], cells(lines[i + 1])), level))
            i = end - 1
        else:
            held.append(lines[i])
        i += 1
    flush()
    return out or parse_text(data)


class _Collector(HTMLParser):
    """Events of a page: text goes to the innermost of heading, cell, or open paragraph; all else is dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[Block] = []
        self.heading, self.level, self.open_heading = None, None, None
        self.text: list[str] = []
        self.title: list[str] = []
        self.depth = 0
        self.rows: list[list[str]] | None = None
        self.row: list[str] = []
        self.cell: list[str] | None = None

    @staticmethod
    def squeezed(parts: list[str]) -> str:
        return " ".join(" ".join(parts).split())

    def flush(self) -> None:
        if text := self.squeezed(self.text):
            self.out.append(Block("text", self.heading, text, self.level))
        self.text = []

    def end_table(self) -> None:
        if self.rows and (text := render(self.rows)):
            self.out.append(Block("table", self.heading, text, self.level))
        self.rows, self.cell = None, None

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "h2", "h3"):
            self.flush()
            self.open_heading, self.title = tag, []
        elif tag in ("p", "li"):
            self.flush()
            self.depth += 1
        elif tag == "table":
            self.flush()
            self.rows = []
        elif self.rows is not None and tag == "tr":
            self.row = []
        elif self.rows is not None and tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag == self.open_heading:
            if name := self.squeezed(self.title):
                self.heading, self.level = name, int(tag[1])
            self.open_heading = None
        elif tag in ("p", "li") and self.depth:
            self.flush()
            self.depth -= 1
        elif self.rows is None:
            return
        elif tag in ("td", "th") and self.cell is not None:
            self.row.append(self.squeezed(self.cell))
            self.cell = None
        elif tag == "tr" and self.row:
            self.rows.append(self.row)
            self.row = []
        elif tag == "table":
            self.end_table()

    def handle_data(self, data):
        if self.open_heading:
            self.title.append(data)
        elif self.cell is not None:
            self.cell.append(data)
        elif self.depth:
            self.text.append(data)


def parse_html(data: str) -> list[Block]:
    """h1 to h3 set the heading, p and li are text blocks, tables become table blocks."""
    c = _Collector()
    c.feed(data)
    c.close()
    c.flush()
    c.end_table()
    return c.out


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _said(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _tag(x) == "t").strip()


def parse_docx(data: bytes) -> list[Block]:
    """Word files: a heading paragraph sets the heading and is a text block; tables are table blocks."""
    out: list[Block] = []
    heading, level = None, None
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(e for e in _xml(z, "word/document.xml") if _tag(e) == "body")
        for e in body:
            if _tag(e) == "p" and (text := _said(e)):
                style = next((v for x in e.iter() if _tag(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
                if m := re.match(r"(?:Heading|Title)\s*(\d*)", style, re.I):
                    heading, level = text, int(m.group(1) or 1)
                out.append(Block("text", heading, text, level))
            elif _tag(e) == "tbl":
                rows = [[c for c in r if _tag(c) == "tc"] for r in e.iter() if _tag(r) == "tr"]
                if text := render(_word_grid(rows)):
                    out.append(Block("table", heading, text, level))
    return out


def _word_grid(rows: list[list[ElementTree.Element]]) -> list[list[str]]:
    """Cells of a Word table as a grid: a cell over several columns or rows says its text in each."""
    grid: list[list[str]] = []
    for row in rows:
        line: list[str] = []
        for cell in row:
            marks = {_tag(x): next((v for k, v in x.attrib.items() if k.endswith("val")), None) for x in cell.iter() if _tag(x) in ("gridSpan", "vMerge")}
            follows = "vMerge" in marks and marks["vMerge"] in (None, "continue")
            above = grid[-1][len(line)] if grid and len(line) < len(grid[-1]) else ""
            line += [above if follows else _said(cell)] * int(marks.get("gridSpan") or 1)
        grid.append(line)
    return grid


def parse_pptx(data: bytes) -> list[Block]:
    """Slides: the first text is the heading and a text block; tables are table blocks."""
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1]).group()))
        for name in slides:
            heading = None
            for e in _xml(z, name).iter():
                if _tag(e) == "sp" and (text := "\n".join(filter(None, (_said(p) for p in e.iter() if _tag(p) == "p")))):
                    heading = heading or text
                    out.append(Block("text", heading, text, 1))
                elif _tag(e) == "tbl" and (text := render([[_said(c) for c in r if _tag(c) == "tc"] for r in e if _tag(r) == "tr"])):
                    out.append(Block("table", heading, text, 1))
    return out


def _column(letters: str) -> int:
    """The place of a column, from 0."""
    return sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1


_REF = re.compile(r"([A-Z]+)(\d+)")


def _sheet_grid(sheet: ElementTree.Element, shared: list[str]) -> tuple[list[list[str]], int]:
    """(rows, header rows) of a worksheet. A merged range says its value in each of its cells; the header is as deep as the
    ranges that begin in its first row."""
    held: dict[tuple[int, int], str] = {}
    for y, r in enumerate((e for e in sheet.iter() if _tag(e) == "row"), 1):
        y = int(r.attrib.get("r", y))
        for x, c in enumerate(e for e in r if _tag(e) == "c"):
            m = _REF.match(c.attrib.get("r", ""))
            x = _column(m.group(1)) if m else x
            value = next((v.text or "" for v in c if _tag(v) == "v"), _said(c))
            held[y, x] = shared[int(value)] if c.attrib.get("t") == "s" else {"1": "TRUE", "0": "FALSE"}.get(value, value) if c.attrib.get("t") == "b" else value
    ranges = []
    for e in sheet.iter():
        if _tag(e) == "mergeCell" and len(ends := _REF.findall(e.attrib.get("ref", ""))) == 2:
            (a, top), (b, bottom) = ends
            ranges.append((int(top), _column(a), int(bottom), _column(b)))
    for top, left, bottom, right in ranges:
        for y in range(top, bottom + 1):
            for x in range(left, right + 1):
                held[y, x] = held.get((top, left), "")
    lines = sorted({y for (y, _), v in held.items() if v.strip()})
    if not lines:
        return [], 0
    width = 1 + max(x for _, x in held)
    first = lines[0]
    last = max([bottom for top, _, bottom, _ in ranges if top == first] + [first + 1 if any(top == first and right > left for top, left, _, right in ranges) else first])
    return [[held.get((y, x), "") for x in range(width)] for y in lines], sum(y <= last for y in lines)


def _one_header(rows: list[list[str]], depth: int) -> list[list[str]]:
    """Header rows as one: the different names above a column, from the top."""
    if depth < 2 or depth >= len(rows):
        return rows
    names = [" / ".join(dict.fromkeys(v.strip() for v in column if v.strip())) for column in zip(*rows[:depth], strict=True)]
    return [names, *rows[depth:]]


def _sheets(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """(name, path) of the worksheets in the workbook's order; by its relations where it has them."""
    relations = {}
    if "xl/_rels/workbook.xml.rels" in z.namelist():
        relations = {e.attrib.get("Id"): e.attrib.get("Target", "").removeprefix("/xl/") for e in _xml(z, "xl/_rels/workbook.xml.rels")}
    for i, e in enumerate((e for e in _xml(z, "xl/workbook.xml").iter() if _tag(e) == "sheet"), 1):
        own = next((v for k, v in e.attrib.items() if k.endswith("}id")), None)
        yield e.attrib["name"], f"xl/{relations.get(own, f'worksheets/sheet{i}.xml')}"


def parse_xlsx(data: bytes) -> list[Block]:
    """Worksheets: the sheet's name is the heading of its table. Merged ranges are filled, header rows become one."""
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [_said(e) for e in _xml(z, "xl/sharedStrings.xml") if _tag(e) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        for name, path in _sheets(z):
            if text := render(_one_header(*_sheet_grid(_xml(z, path), shared))):
                out.append(Block("table", name, text, 1))
    return out


def _decoded(f: Callable[[str], list[Block]]) -> Callable[[bytes], list[Block]]:
    return lambda data: f(data.decode("utf-8"))


#: Parsers by file extension; pdf takes text that a reader has already turned into markdown.
PARSERS: dict[str, Callable[[bytes], list[Block]]] = {
    "txt": _decoded(parse_text),
    "md": _decoded(parse_markdown),
    "html": _decoded(parse_html),
    "htm": _decoded(parse_html),
    "docx": parse_docx,
    "pptx": parse_pptx,
    "xlsx": parse_xlsx,
    "pdf": _decoded(lambda s: parse_markdown(s, short_rules=True)),
}

#: What a file that cannot be read raises.
UNREADABLE = (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError)
_BLOCKS = "document_id long, block_index int, block_kind string, heading string, heading_level int, content string, start_offset int, end_offset int, error string"


def placed(blocks: list[Block]) -> Iterator[tuple[int, Block, int, int]]:
    """Non-blank blocks with their span in the text that joins them by blank lines."""
    at = 0
    for i, b in enumerate(x for x in blocks if x.text.strip()):
        b.text = b.text.strip()
        yield i, b, at, at + len(b.text)
        at += len(b.text) + 2


def parse_files(files: DataFrame) -> DataFrame:
    """files (document_id, file_name, content binary) to block rows; a file that cannot be parsed is one row with the error."""

    def run(batches):
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            rows: list[tuple] = []
            for doc, name, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                extension = (name or "").rsplit(".", 1)[-1].lower()
                try:
                    if extension not in PARSERS:
                        raise ValueError(f"no parser for .{extension}")
                    found = [(doc, i, b.kind, b.heading, b.level, b.text, s, e, None) for i, b, s, e in placed(PARSERS[extension](data or b""))]
                    if not found:
                        raise ValueError("no text")
                    rows += found
                except UNREADABLE as e:
                    rows.append((doc, 0, None, None, None, None, 0, 0, str(e) or type(e).__name__))
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _BLOCKS.split(", ")])

    return bounded(files.select(F.col("document_id").cast("long"), "file_name", "content")).mapInArrow(run, _BLOCKS)
