"""Spans of a text as rows of digests, shared by the scanners."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

Span = tuple[str, int, int]


def joined(spans: list[Span], kinds: list[str]) -> str:
    """kind:start:end by start, then kind in the order of kinds, comma-joined."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


def scan_rows(docs: DataFrame, find: Callable[[str], tuple[list[Span], list[Span]]], counted: list[str], kinds: list[str], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_<kind> of the base spans, base_sha256, spans for every row; find gives (base spans, added spans)."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(len(counted) + 2)]
            for text in batch.column(1):
                base, added = find(text.as_py() or "")
                n = Counter(k for k, _, _ in base)
                for i, k in enumerate(counted):
                    out[i].append(n[k])
                text_of = joined(base, kinds)
                out[-2].append(hashlib.sha256(text_of.encode()).hexdigest())
                out[-1].append(joined([*base, *added], kinds) if added else text_of)
            cols = [pa.array(c, pa.int64()) for c in out[:-2]] + [pa.array(c, pa.string()) for c in out[-2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *(f"n_{k}" for k in counted), "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.lean(rows).mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in counted) + ", base_sha256 string, spans string")
