"""Chunk trees: parsed blocks to parents and children with exact offsets in the display text."""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings, bounded
from .parsing import PARSERS, Block, cells, placed

_GAP = "\n\n"


@dataclass(frozen=True)
class Section:
    """A parent to be: its text, and the parts it was made of where kinds are mixed."""

    kind: str
    text: str
    heading: str | None = None
    path: str | None = None
    parts: tuple[tuple[str, str | None, int, str], ...] = field(default=())  # kind, heading, offset, text

    def pieces(self) -> tuple[tuple[str, str | None, int, str], ...]:
        return self.parts or ((self.kind, self.heading, 0, self.text),)


def segments(heading: str | None) -> list[str]:
    """The steps of a heading path."""
    return [s for s in re.split(r"\s+/\s+", " ".join((heading or "").split())) if s]


def same_family(a: str | None, b: str | None) -> bool:
    """One path leads to the other, or both are empty."""
    x, y = segments(a), segments(b)
    return x == y if not x or not y else x[: len(y)] == y[: len(x)]


def _joined(a: str | None, b: str | None, longer: bool) -> str | None:
    """Of two related paths the shorter or longer; unrelated ones in a row; the one there is otherwise."""
    if not a or not b or a == b:
        return a or b
    if same_family(a, b):
        return max(a, b, key=lambda p: len(segments(p))) if longer else min(a, b, key=lambda p: len(segments(p)))
    return f"{a} / {b}"


def merge(sections: list[Section], keep_parts: bool, kind: str = "text") -> Section:
    """Sections in a row as one; headings keep the shorter path, paths the longer."""
    heading = path = None
    at, parts = 0, []
    for s in sections:
        heading, path = _joined(heading, s.heading, False), _joined(path, s.path, True)
        parts += [(k, h, at + o, t) for k, h, o, t in s.pieces()]
        at += len(s.text) + len(_GAP)
    return Section(kind, _GAP.join(s.text for s in sections), heading, path, tuple(parts) if keep_parts else ())


def _pair(a: Section, b: Section) -> Section:
    if a.kind == b.kind:
        return merge([a, b], bool(a.kind == "text" and (a.parts or b.parts)), a.kind)
    return merge([a, b], True)


def sections_of(blocks: list[Block], plain: bool, s: Settings = DEFAULTS) -> list[Section]:
    """Sections before normalising: groups of paragraphs for plain text, else a section a block with its heading path."""
    if plain:
        paragraphs = [p.strip() for b in blocks for p in re.split(r"\n\s*\n", b.text) if p.strip()]
        n = s.txt_parent_group_size
        return [Section("text", _GAP.join(paragraphs[i : i + n])) for i in range(0, len(paragraphs), n)]
    out, stack = [], []
    for b in blocks:
        name = " ".join((b.heading or "").split())
        if name and b.level:
            stack = stack[: b.level - 1] + [name] if stack[-1:] != [name] or len(stack) != b.level else stack
        elif name and stack[-1:] != [name]:
            stack = [name]
        out.append(Section(b.kind, b.text, b.heading, " / ".join(stack) or None))
    return out


def normalise(sections: list[Section], least: int = DEFAULTS.min_parent_section_length) -> list[Section]:
    """Short text parents fold forward, then backward; then short parents of any kind merge with neighbours of their
    heading's family until none can, towards the length nearest to `least`, the right one on ties."""
    short = lambda x: len(x.text) < least
    folded: list[Section] = []
    queue = list(reversed(sections))
    while queue:
        now = queue.pop()
        while now.kind == "text" and short(now) and queue and queue[-1].kind == "text":
            now = merge([now, queue.pop()], False)
        if now.kind == "text" and short(now) and folded and folded[-1].kind == "text":
            now = merge([folded.pop(), now], False)
        folded.append(now)

    def step(row: list[Section]) -> list[Section] | None:
        for i, now in enumerate(row):
            if not short(now) or len(row) < 2:
                continue
            left = i > 0 and same_family(now.heading, row[i - 1].heading)
            right = i + 1 < len(row) and same_family(now.heading, row[i + 1].heading)
            if left and right and now.kind == "table" and row[i - 1].kind == row[i + 1].kind == "text":
                return [*row[: i - 1], merge(row[i - 1 : i + 2], True), *row[i + 2 :]]
            options = ([(i, _pair(now, row[i + 1]))] if right else []) + ([(i - 1, _pair(row[i - 1], now))] if left else [])
            if options:
                at, made = min(options, key=lambda o: abs(len(o[1].text) - least))
                return [*row[:at], made, *row[at + 2 :]]
        return None

    while (after := step(folded)) is not None:
        folded = after
    return folded


def consolidate(sections: list[Section], least: int = DEFAULTS.min_parent_section_length) -> list[Section]:
    """Of a PDF's fine sections, before normalise(), those under one heading together: a table with the short texts around
    it is one parent of mixed parts; texts gather until they have `least` characters, what stays short joins the text
    before it; tables in a row are one."""
    out: list[Section] = []
    rest = deque(sections)
    while rest:
        trio = [rest[i] for i in range(min(3, len(rest)))]
        if [s.kind for s in trio] == ["text", "table", "text"] and len({s.heading for s in trio}) == 1 and max(len(trio[0].text), len(trio[2].text)) < least:
            out.append(merge(trio, True))
            for _ in trio:
                rest.popleft()
            continue
        now = rest.popleft()
        while now.kind == "text" and len(now.text) < least and rest and (rest[0].kind, rest[0].heading) == ("text", now.heading):
            now = merge([now, rest.popleft()], False)
        if out and (out[-1].kind, out[-1].heading) == (now.kind, now.heading) and (now.kind == "table" or len(now.text) < least):
            now = merge([out.pop(), now], False, now.kind)
        out.append(now)
    return out


def split_text(text: str, size: int = DEFAULTS.target_child_length, overlap: int = DEFAULTS.child_overlap) -> list[tuple[int, int]]:
    """Spans of at most `size` characters: cut at the coarsest separator that works (blank line, line, space, character),
    pieces gathered up to the size, the next span starting with as many last pieces as fit the overlap; trimmed."""

    def atoms(a: int, b: int, separators: tuple[str, ...]) -> list[tuple[int, int]]:
        if b - a <= size:
            return [(a, b)]
        if not separators:
            return [(i, i + 1) for i in range(a, b)]
        starts = [a] + [m.start() for m in re.finditer(re.escape(separators[0]), text[a:b]) if m.start()] if separators[0] in text[a:b] else None
        if starts is None:
            return atoms(a, b, separators[1:])
        marks = [a, *(a + m for m in starts[1:]), b]
        return [x for i, j in zip(marks, marks[1:], strict=False) for x in atoms(i, j, separators[1:])]

    out: list[tuple[int, int]] = []
    window: list[tuple[int, int]] = []
    for piece in atoms(0, len(text), ("\n\n", "\n", " ")):
        if window and piece[1] - window[0][0] > size:
            out.append((window[0][0], window[-1][1]))
            while window and (window[-1][1] - window[0][0] > overlap or piece[1] - window[0][0] > size):
                window.pop(0)
        window.append(piece)
    if window:
        out.append((window[0][0], window[-1][1]))
    trimmed = []
    for a, b in out:
        body = text[a:b]
        a += len(body) - len(body.lstrip())
        b -= len(body) - len(body.rstrip())
        if a < b and (not trimmed or b > trimmed[-1][1]):
            trimmed.append((a, b))
    return trimmed


#: Headings of sections that state facts, and the least length that is refined (fixed values).
FACT_HEADINGS, FACT_LEAST = re.compile(r"(dataset|experimental setup|evaluation metrics|metrics|setup)", re.I), 240
_SENTENCE_END = re.compile(r"[。！？.!?](?:\s+|$)|\n\n")


def sentence_windows(text: str) -> list[tuple[int, int]]:
    """Trimmed spans between the ends of sentences (a mark before white space or the end) and blank lines."""
    out, at = [], 0
    for end in [*(m.end() for m in _SENTENCE_END.finditer(text)), len(text)]:
        body = text[at:end]
        if body.strip():
            out.append((at + len(body) - len(body.lstrip()), at + len(body.rstrip())))
        at = end
    return out


def text_spans(text: str, heading: str | None, s: Settings = DEFAULTS) -> list[tuple[int, int]]:
    """Child spans of a text section: of fact-heavy sections, where that is asked for, its sentences; else split_text()."""
    if s.fact_heavy_refinement and FACT_HEADINGS.search(heading or "") and len(text) >= FACT_LEAST:
        windows = sentence_windows(text)
        if len(windows) > 1:
            return windows
    return split_text(text, s.target_child_length, s.child_overlap)


def split_table(text: str, s: Settings = DEFAULTS) -> list[tuple[int, int, str]]:
    """(start, end, content) of a table's children: whole if short, else groups of rows under the repeated header;
    offsets cover the data rows only."""
    lines = text.split("\n")
    if len(text) <= s.table_preserve_chars or len(lines) < 3 or not cells(lines[2]):
        return [(0, len(text), text)]
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    out = []
    for i in range(2, len(lines), s.table_rows_per_child):
        group = lines[i : i + s.table_rows_per_child]
        out.append((starts[i], starts[i + len(group)] - 1, "\n".join([*lines[:2], *group])))
    return out


@dataclass(frozen=True)
class Chunk:
    """A row of the chunk tree."""

    chunk_type: str
    structure_kind: str
    position: int
    section_index: int
    child_index: int | None
    heading: str | None
    path: str | None
    content: str
    start_offset: int
    end_offset: int


def build(blocks: list[Block], plain: bool, s: Settings = DEFAULTS, pdf: bool = False) -> tuple[str, list[Chunk]]:
    """The display text and its parents with children; a heading is shown as `## heading` before its parent's text,
    and the parent's span includes it."""
    display, chunks = "", []
    drafts = sections_of(blocks, plain, s)
    drafts = consolidate(drafts, s.min_parent_section_length) if pdf else drafts
    for index, section in enumerate(normalise(drafts, s.min_parent_section_length)):
        begin = len(display) + (len(_GAP) if display else 0)
        prefix = f"## {section.heading}{_GAP}" if section.heading else ""
        body = begin + len(prefix)
        display += (_GAP if display else "") + prefix + section.text
        chunks.append(Chunk("parent", section.kind, len(chunks), index, None, section.heading, section.path or f"Section {index + 1}", section.text, begin, body + len(section.text)))
        n = 0
        for kind, heading, offset, text in section.pieces():
            spans = split_table(text, s) if kind == "table" else [(a, b, text[a:b]) for a, b in text_spans(text, heading or section.heading, s)]
            for a, b, content in spans:
                chunks.append(Chunk("child", kind, len(chunks), index, n, heading or section.heading, None, content, body + offset + a, body + offset + b))
                n += 1
    return display, chunks


_CHUNKS = "document_id long, chunk_type string, structure_kind string, position int, section_index int, child_index int, heading string, section_path string, content string, content_preview string, char_count int, start_offset int, end_offset int"
_TREE = f"{_CHUNKS}, display_text string"


def chunk_files(files: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """files (document_id, file_name, content binary) to chunk rows, parse and tree in one pass without a shuffle.

    The display text stands on the first row of each document. Files without text give no rows.
    """

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int32()] * 3, *[pa.string()] * 4, *[pa.int32()] * 3, pa.string()]
        for batch in batches:
            rows: list[tuple] = []
            for doc, name, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                extension = (name or "").rsplit(".", 1)[-1].lower()
                blocks = [b for _, b, _, _ in placed(PARSERS[extension](data or b""))] if extension in PARSERS else []
                display, chunks = build(blocks, extension == "txt", s, extension == "pdf")
                for c in chunks:
                    preview = " ".join(c.content.split())[: s.preview_length]
                    rows.append((doc, c.chunk_type, c.structure_kind, c.position, c.section_index, c.child_index, c.heading, c.path, c.content, preview, len(c.content), c.start_offset, c.end_offset, display if not c.position else None))
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _TREE.split(", ")])

    return bounded(files.select(F.col("document_id").cast("long"), "file_name", "content")).mapInArrow(run, _TREE)


def with_settings(**changes) -> Settings:
    return replace(DEFAULTS, **changes)
