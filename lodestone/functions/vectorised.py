"""Scores of bounded candidate rows that are too costly as column expressions, an Arrow batch at a time.

They give what the column expressions of text and scoring give, bit for bit; a query's words are taken once a batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space by the property of that name (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_RUN = re.compile(f"[{WHITE}]+")
_TOKEN = re.compile(f"[A-Za-z0-9][A-Za-z0-9._/-]*|[{chr(0x3400)}-{chr(0x4DBF)}{chr(0x4E00)}-{chr(0x9FFF)}]+")
_LINES = re.compile(f"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85{chr(0x2028)}{chr(0x2029)}]")


def fold(t: str) -> str:
    return t.lower().replace("ß", "ss")


@lru_cache(1024)
def query_tokens(query: str) -> tuple[str, ...]:
    """text.query_tokens of one query."""
    out: dict[str, None] = {}
    for t in _TOKEN.findall(fold(_RUN.sub(" ", query).strip(" "))):
        out[t] = None
        if t[0] >= chr(0x3400):
            out.update((t[i : i + 2], None) for i in range(max(1, len(t) - 1)))
    return tuple(out)


@lru_cache(1024)
def white_tokens(query: str) -> tuple[str, ...]:
    return tuple(t for t in _RUN.split(query.lower()) if t)


def policy_score(rrf: float, query: str, heading: str | None, content: str) -> float:
    """scoring.policy_score of one candidate."""
    q, h, c = query.strip(" ").lower(), (heading or "").lower(), content.lower()
    tokens = query_tokens(query)
    in_heading = bool(q) and q in h
    hits = lambda t, most: min(most, sum(token in t for token in tokens))
    out = rrf + (0.08 if q and q in c else 0.0) + (0.12 if in_heading else 0.0)
    out = out + hits(h, 4) * 0.025 + hits(c, 6) * 0.008
    return out - ((0.09 if in_heading else 0.12) if "." * 64 in content else 0.0)


@F.pandas_udf(T.DoubleType())
def policy_scores(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for rrf, query, heading, content in batches:
        yield pd.Series([policy_score(*row) for row in zip(rrf, query, heading, content, strict=True)], dtype="float64")


def _strip(t: str) -> str:
    return t.strip(WHITE)


def merged(kind: str, parts: list[str]) -> str:
    """text.merge_contents of one group's stripped, non-blank parts."""
    if kind != "table":
        return "\n\n".join(parts)
    out: list[str] = []
    for i, part in enumerate(parts):
        lines = [x for x in (line.rstrip(WHITE) for line in _LINES.split(part)) if x]
        out += lines if not i or len(lines) < 3 else lines[2:]
    return _strip("\n".join(out))


def clipped(t: str, chars: int) -> str:
    if chars <= 0:
        return ""
    if len(t) <= chars:
        return t
    return t[:chars] if chars <= 3 else t[: chars - 3] + "..."


def _shares(kids: list[str], chars: int) -> str:
    """The numbered children cut to so many characters in all: each may use its share of what the ones before left."""
    labels = [f"[Hit child {i + 1}]\n" for i in range(len(kids))]
    room = chars - sum(map(len, labels)) - 2 * (len(kids) - 1)
    if room <= 0:
        return clipped("\n\n".join(a + b for a, b in zip(labels, kids, strict=True)), chars)
    out = []
    for i, kid in enumerate(kids):
        part = clipped(kid, max(1, room // (len(kids) - i)))
        room -= len(part)
        out.append(labels[i] + part)
    return clipped("\n\n".join(out), chars)


def budget(base: int, hits: int) -> int:
    """rerank.budget of so many hit children."""
    return min(base * 5 // 2 if hits >= 3 else base * 2 if hits == 2 else base, max(5000, base))


def rerank_text(kind: str, heading: str | None, contents: list[str], base: int) -> str:
    """Heading and content within the budget; if the content is too long and several children were hit, the children's shares of it."""
    kids = [k for k in map(_strip, contents) if k]
    content, whole = merged(kind, kids), budget(base, len(kids))
    prefix = _strip("Header: " + _strip(heading or ""))
    room = whole - len(prefix) - len("\nContent:\n")
    if room <= 0:
        body = ""
    elif len(content) <= room:
        body = content
    elif len(kids) <= 1:
        body = content[:room]
    else:
        bundle = "\n\n".join(f"[Hit child {i}]\n{kid}" for i, kid in enumerate(kids, 1))
        body = bundle if len(bundle) <= room else _shares(kids, room)
    return _strip(prefix + "\nContent:\n" + body)[:whole]


def rerank_texts(base: int):
    """A function of the columns structure_kind, heading, contents (array) to the text to rerank."""

    @F.pandas_udf(T.StringType())
    def texts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for kind, heading, contents in batches:
            yield pd.Series([rerank_text(k, h, list(c), base) for k, h, c in zip(kind, heading, contents, strict=True)], dtype=object)

    return texts


def deterministic_rerank(query: str, candidate: str, text: str) -> float:
    """scoring.deterministic_rerank of one group."""
    low = text.lower()
    digest = hashlib.sha256("\0".join((query, candidate, text)).encode("utf-8", "surrogatepass")).digest()
    return sum(low.count(t) for t in white_tokens(query)) + int.from_bytes(digest[:8]) / float(2**64 - 1)


@F.pandas_udf(T.DoubleType())
def rerank_scores(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for query, candidate, text in batches:
        yield pd.Series([deterministic_rerank(*row) for row in zip(query, candidate, text, strict=True)], dtype="float64")
