"""Page layout: elements of an external PDF reader matched to parsed blocks, their pages and boxes."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of one block at most (fixed value).
MOST = 4
_BOX = ("left", "bottom", "right", "top")
# Names under which readers give the same thing (fixed values).
_ALIASES = {"regions": ("regions", "bboxes", "boxes", "bbox"), "page": ("page_number", "page number", "page", "pageNumber"), "left": ("left", "x0", "bbox_left"), "bottom": ("bottom", "y0", "bbox_bottom"), "right": ("right", "x1", "bbox_right"), "top": ("top", "y1", "bbox_top"), "text": ("content", "text"), "kind": ("type", "element_kind", "kind"), "level": ("heading_level", "heading level", "level")}
_OUT = "document_id long, block_index int, page_start int, page_end int, heading_level int, regions array<struct<page:int,left:double,bottom:double,right:double,top:double>>"


def _get(item: dict, name: str):
    return next((item[k] for k in _ALIASES[name] if item.get(k) is not None), None)


def _boxes(item: dict) -> list[dict]:
    raw = _get(item, "regions") or []
    if isinstance(raw, list) and len(raw) == 4 and all(isinstance(x, (int, float)) for x in raw):
        raw = [dict(zip(_BOX, raw, strict=True))]
    out = []
    for box in [raw] if isinstance(raw, dict) else raw:
        side = {n: _get(box, n) for n in _BOX}
        page = _get(box, "page") or _get(item, "page")
        if page is not None and None not in side.values():
            out.append({"page": int(page)} | {n: float(v) for n, v in side.items()})
    return out


def elements(payload: str | None) -> list[dict]:
    """Elements of a reader's JSON, in reading order: kind, text, page, level, boxes; boxes without a side are left out.

    Nested lists are walked; what is not JSON has no elements.
    """
    try:
        root = json.loads(payload or "")
    except ValueError:
        return []
    out: list[dict] = []

    def walk(node) -> None:
        if isinstance(node, list):
            for x in node:
                walk(x)
        elif isinstance(node, dict):
            text, kind = _get(node, "text"), _get(node, "kind")
            if isinstance(text, str) and kind:
                out.append({"table": "table" in str(kind).lower(), "text": " ".join(text.split()), "page": _get(node, "page"), "level": _get(node, "level"), "boxes": _boxes(node)})
            for key in ("elements", "kids", "children", "pages"):
                walk(node.get(key) or [])

    walk(root)
    return out


def match(blocks: Iterable[tuple[str, str]], found: list[dict]) -> list[list[dict]]:
    """The elements of each block (kind, text): a walk in step over both lists. Elements of the other kind before a
    block's first are passed over; a block takes elements until its text holds theirs or theirs holds it, four at most."""
    out, at = [], 0
    for kind, text in blocks:
        wanted, own, joined = " ".join(text.split()), [], ""
        while at < len(found):
            if found[at]["table"] != (kind == "table"):
                if own:
                    break
                at += 1
                continue
            own.append(found[at])
            joined = f"{joined} {found[at]['text']}".strip()
            at += 1
            if not wanted or wanted in joined or joined in wanted or len(own) == MOST:
                break
        out.append(own)
    return out


def enrich(documents: DataFrame) -> DataFrame:
    """documents (document_id, blocks array<struct<block_kind,content>>, payload JSON) to page spans and boxes per block."""

    def run(batches):
        box = pa.struct([("page", pa.int32()), *((n, pa.float64()) for n in _BOX)])
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(box)]
        for batch in batches:
            rows = []
            for doc, blocks, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, own in enumerate(match([(b["block_kind"], b["content"]) for b in blocks or []], elements(payload))):
                    boxes = [b for e in own for b in e["boxes"]]
                    pages = [b["page"] for b in boxes] or [int(e["page"]) for e in own if e["page"] is not None]
                    rows.append((doc, i, min(pages, default=None), max(pages, default=None), own[0]["level"] if own else None, boxes))
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["document_id", "block_index", "page_start", "page_end", "heading_level", "regions"])

    return documents.select(F.col("document_id").cast("long"), "blocks", "payload").mapInArrow(run, _OUT)
