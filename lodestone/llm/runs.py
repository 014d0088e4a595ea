"""Periodic runs: stretches of words that repeat with a period, found by matching aligned blocks.

A run of period q has at least 4 q words, so for the power of two b with b <= q < 2 b some block of b words that starts at a
multiple of b lies in the run together with its copy q words later. At each scale b the document's aligned blocks become
the keys (sequences of word numbers) of one Aho-Corasick automaton, which is searched across the whole document; an
occurrence of a block b to 2 b - 1 words after it seeds that distance as a period, and the seed is extended word by word
in both directions, exactly. What keeps this near n log n in any text:

* a block whose first half does not occur again as far away as the next scale asks is no key there, so that text without
  long repeats ends after a few scales;
* a block that lies, with all its copies that could seed, inside a run found at a smaller scale is not asked again: two
  periods of one stretch have their greatest common divisor as a period, so it could seed multiples of that period only;
* a seed inside the last stretch extended with its period is that stretch.

Blocks of one word (b = 1, so distance 1) are compared as one array.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Run:
    start: int
    length: int
    period: int


#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4


def numbers(words: list[bytes]) -> np.ndarray:
    """A number for each distinct word."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading elements are equal, read in pieces of growing size."""
    at, size, n = 0, 64, min(len(x), len(y))
    while at < n:
        differs = x[at : min(n, at + size)] != y[at : min(n, at + size)]
        if differs.any():
            return at + int(differs.argmax())
        at, size = at + size, 2 * size
    return n


def extend(ids: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The maximal stretch [start, end) of the period around `at`, where ids[at] == ids[at + period]."""
    start = at - _agree(ids[:at][::-1], ids[period : at + period][::-1])
    return start, at + period + _agree(ids[at:], ids[at + period :])


class _Known:
    """Runs of smaller scales: how far a run that starts at or before a word reaches."""

    def __init__(self, runs: list[Run]):
        order = sorted(runs, key=lambda r: r.start)
        self.starts = np.array([r.start for r in order], np.int64)
        self.ends = np.maximum.accumulate(np.array([r.start + r.length for r in order], np.int64)) if order else self.starts

    def reach(self, at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.starts, at, "right") - 1
        return np.where(k >= 0, self.ends[k], 0) if len(self.starts) else np.zeros(len(at), np.int64)


def _occurrences(ids: np.ndarray, sequence: tuple[int, ...], blocks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each block, and key * (n + 1) + start, sorted, of every occurrence of a key in the document."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    key_of: dict[tuple[int, ...], int] = {}
    keys = np.zeros(len(blocks), np.int64)
    for k, at in enumerate(blocks.tolist()):
        block = sequence[at : at + size]
        key = key_of.get(block)
        if key is None:
            key = key_of[block] = len(key_of)
            automaton.add_word(block, key)
        keys[k] = key
    automaton.make_automaton()
    hits = np.array(list(automaton.iter(sequence)), np.int64).reshape(-1, 2)  # (last word, key), each block once at least
    return keys, np.sort(hits[:, 1] * (len(ids) + 1) + hits[:, 0] - size + 1)


def _grow(ids: np.ndarray, seeds: list[tuple[int, int]], size: int, known: _Known) -> list[Run]:
    """Runs from seeds (period, start of block), sorted."""
    out, last, end = [], 0, 0
    inside = known.reach(np.array([s for _, s in seeds], np.int64)).tolist()
    for (period, at), covered in zip(seeds, inside, strict=True):
        if period != last:
            last, end = period, 0
        if at + period + size <= max(end, covered):
            continue
        start, end = extend(ids, at, period)
        if end - start >= max(LEAST, TIMES * period):
            out.append(Run(start, end - start, period))
    return out


def find(ids: np.ndarray) -> list[Run]:
    """All runs of a sequence of word numbers, by start, then period."""
    n = len(ids)
    if n < LEAST:
        return []
    runs = _grow(ids, [(1, s) for s in np.flatnonzero(ids[1:] == ids[:-1]).tolist()], 1, _Known([]))
    sequence, size = None, 2
    blocks = np.arange(0, n - 1, 2)
    last = np.zeros(int(ids.max()) + 1, np.int64)
    last[ids] = np.arange(n)  # of repeated indices the last value stays
    alive = last[ids[blocks]] >= blocks + 2  # what blocks of one word say about blocks of two
    while 4 * size <= n:
        known = _Known(runs)
        blocks = blocks[alive]
        open_ = known.reach(blocks) < np.minimum(blocks + 3 * size, n)
        asked = blocks[open_]
        again = np.ones(len(blocks), bool)  # of a block in a run nothing is known
        if len(asked):
            sequence = sequence or tuple(ids.tolist())
            keys, found = _occurrences(ids, sequence, asked, size)
            base = keys * (n + 1)
            first, beyond, end = (np.searchsorted(found, base + np.minimum(at, n)) for at in (asked + size, asked + 2 * size, n + 0 * asked))
            times = beyond - first
            owner = np.repeat(np.arange(len(asked)), times)
            place = np.repeat(first, times) + np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
            starts = asked[owner]
            runs += _grow(ids, sorted(zip((found[place] - base[owner] - starts).tolist(), starts.tolist(), strict=True)), size, known)
            again[open_] = end > beyond
        elif not len(blocks):
            break
        size *= 2
        alive = again & (blocks % size == 0) & (blocks + size <= n)
    return sorted(runs, key=lambda r: (r.start, r.period))


def kept(n: int, runs: list[Run]) -> np.ndarray:
    """Which words stay when every run is cut to its first period; a word that any run drops goes."""
    step = np.zeros(n + 1, np.int64)
    for r in runs:
        step[r.start + r.period] += 1
        step[r.start + r.length] -= 1
    return np.cumsum(step[:n]) == 0


def collapse(text: str | None) -> str:
    """The words of a text, each run cut to its first period, joined by one space."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return b" ".join(w for w, k in zip(words, kept(len(words), find(numbers(words))), strict=True) if k).decode("utf-8", "surrogatepass")


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, a tail of them made periodic in documents whose id's CRC-32 ends in 0 (decimal); null ids never."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


_COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest(words: list[bytes]) -> tuple:
    """The values of _COLUMNS for one document's words."""
    runs = find(numbers(words))
    longest = min(runs, key=lambda r: (-r.length, r.start, r.period), default=None)
    rest = [w for w, k in zip(words, kept(len(words), runs).tolist(), strict=True) if k] if runs else words
    best = (longest.start, longest.length, longest.period, 1000 * longest.length // longest.period) if longest else (None,) * 4
    listed = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
    return len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(rest)).hexdigest()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return common.lean(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_runs, the longest run's start, length, period and exponent_milli, digests of all runs
    and of the collapsed text. `plant` makes tails periodic first (see planted()).

    Null and empty texts have no words: no runs, four nulls, digests of nothing. Null ids and repeated rows are kept; a text
    of any length is searched whole; of runs equally long the first, then the one of smaller period counts; other columns are
    not read; no rows give no rows.
    """

    def scan(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                rows.append(digest(planted(words, doc_id) if plant else words))
            columns = list(zip(*rows, strict=True)) or [[]] * len(_COLUMNS)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *_COLUMNS])

    return _texts(docs, id_col, text_col).mapInArrow(scan, _SCHEMA)


def run_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run of each row's text: doc_id, start, length, period (word numbers from 0), and unit, the repeated words.

    Rows without a run give none; otherwise as periodic_runs().
    """

    def scan(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                for r in find(numbers(words)):
                    out.append((doc_id, r.start, r.length, r.period, b" ".join(words[r.start : r.start + r.period]).decode("utf-8", "replace")))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc_id", "start", "length", "period", "unit"])

    return _texts(docs, id_col, text_col).mapInArrow(scan, "doc_id long, start long, length long, period long, unit string")


def collapse_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the words of text_col collapsed where the text has a run; texts without one, and nulls, stay as they are."""
    names, at = docs.columns, docs.columns.index(text_col)

    def scan(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, text in enumerate(texts):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                runs = find(numbers(words))
                if runs:
                    texts[i] = b" ".join(w for w, k in zip(words, kept(len(words), runs).tolist(), strict=True) if k).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]], names)

    return common.lean(docs).mapInArrow(scan, docs.schema)
