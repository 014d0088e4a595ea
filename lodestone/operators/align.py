"""Evidence alignment: normalised exact matches with source offsets, choice among several, fuzzy lines."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import bounded

#: A fuzzy line is accepted from this score on, if it leads by this margin (fixed values).
ACCEPT, MARGIN = 0.92, 0.05
#: Characters around a match that its context score reads.
AROUND = 120
#: Words of an anchor.
ANCHOR = 4
_OUT = "item_id long, document_id long, status string, start_offset int, end_offset int, match_type string, score double, candidates int"


def normalised(text: str) -> tuple[str, list[int]]:
    """Compatibility-normalised lower-case text with single spaces, and the source position of each of its characters.

    Soft hyphens vanish; a hyphen at a line's end joins the halves of its word.
    """
    out: list[str] = []
    at: list[int] = []
    for m in re.finditer(r"­|-[\n\r][\n\r ]*|[^­]", text, re.S):
        piece = m.group()
        if piece == "­" or len(piece) > 1:
            continue
        for c in unicodedata.normalize("NFKC", piece).lower():
            if not c.isspace():
                out.append(c)
                at.append(m.start())
            elif out and out[-1] != " ":
                out.append(" ")
                at.append(m.start())
    if out and out[-1] == " ":
        out.pop()
        at.pop()
    return "".join(out), at


def flattened(text: str) -> str:
    """The text of normalised(), without positions: each distinct character is normalised once."""
    text = re.sub(r"\u00ad|-[\n\r][\n\r ]*", "", text)
    if not text.isascii():
        return " ".join(text.translate({ord(c): unicodedata.normalize("NFKC", c).lower() for c in set(text)}).split())
    return " ".join(text.lower().split())


def anchors(evidence: str) -> list[str]:
    """Runs of ANCHOR words of the normalised evidence that cover all of it; a text that aligns well holds one of them."""
    w = normalised(evidence)[0].strip().split(" ")
    starts = [*range(0, len(w) - ANCHOR, ANCHOR), max(0, len(w) - ANCHOR)]
    return [a for a in dict.fromkeys(" ".join(w[s : s + ANCHOR]) for s in starts) if a]


def flat(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, flat) with the normalised texts."""

    def run(batches):
        for batch in batches:
            texts = [flattened(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "flat"])

    return bounded(docs.select(F.col(id_col).cast("long").alias(id_col), text_col)).mapInArrow(run, f"{id_col} long, flat string")


def words(text: str) -> frozenset[str]:
    return frozenset(re.findall(r"[A-Za-z0-9一-鿿]+", text.lower()))


def shared(a: frozenset[str], b: frozenset[str]) -> float:
    """Jaccard overlap of two word sets."""
    return len(a & b) / len(a | b) if a and b else 0.0


def exact_spans(text: str, evidence: str) -> list[tuple[int, int]]:
    """Source spans of all occurrences, overlapping ones too, of the evidence after normalising both."""
    flat, at = normalised(text)
    wanted, _ = normalised(evidence)
    found: dict[tuple[int, int], None] = {}
    i = flat.find(wanted) if wanted else -1
    while i >= 0:
        found[at[i], at[i + len(wanted) - 1] + 1] = None
        i = flat.find(wanted, i + 1)
    return list(found)


def choose(text: str, spans: list[tuple[int, int]], signal: str) -> tuple[int, int] | None:
    """The span whose surroundings share most with the signal, if one leads; the only one there is."""
    if len(spans) < 2:
        return spans[0] if spans else None
    score = sorted(((-round(shared(words(signal), words(text[max(0, s - AROUND) : e + AROUND])), 6), s, e) for s, e in spans))
    return score[0][1:] if score[0][0] < score[1][0] else None


def fuzzy_line(text: str, evidence: str, signal: str) -> tuple[int, int, float] | None:
    """The line most like the evidence (seven parts likeness, three parts shared words), if it is sure."""
    wanted, _ = normalised(evidence)
    ask = words(signal)
    lines = [(m.start(), m.end(), m.group().strip()) for m in re.finditer(r"[^\n]+", text) if m.group().strip()]
    scored = sorted((-round(0.7 * SequenceMatcher(None, wanted, normalised(x)[0]).ratio() + 0.3 * shared(ask, words(x)), 6), s, e) for s, e, x in lines) if wanted else []
    if not scored:
        return None
    lead = -scored[0][0] - (-scored[1][0] if len(scored) > 1 else 0.0)
    return (scored[0][1], scored[0][2], -scored[0][0]) if -scored[0][0] >= ACCEPT and lead >= MARGIN else None


def align(pairs: DataFrame) -> DataFrame:
    """pairs (item_id, document_id, display_text, evidence, signal) with one status row each.

    A clear exact match is auto_matched, several without a leader need review, else a sure fuzzy line is auto_matched,
    else the item is rejected. Texts are read where they are; no pairs are made here.
    """

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
        for batch in batches:
            rows = []
            for item, doc, text, evidence, signal in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = exact_spans(text or "", evidence or "")
                one = choose(text or "", spans, signal or "")
                if one:
                    rows.append((item, doc, "auto_matched", *one, "exact", 1.0, len(spans)))
                elif spans:
                    rows.append((item, doc, "needs_review", None, None, "exact", None, len(spans)))
                elif near := fuzzy_line(text or "", evidence or "", signal or ""):
                    rows.append((item, doc, "auto_matched", near[0], near[1], "fuzzy", near[2], 1))
                else:
                    rows.append((item, doc, "rejected", None, None, None, None, 0))
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _OUT.split(", ")])

    return pairs.select(F.col("item_id").cast("long"), F.col("document_id").cast("long"), "display_text", "evidence", "signal").mapInArrow(run, _OUT)
