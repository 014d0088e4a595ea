"""Packing of tokenised documents into sequences by a linear grouping scheme.

Only a histogram of piece lengths (at most `capacity` rows) reaches the driver, which plans on it:
1. full pieces are sequences by themselves; other pieces longer than capacity / SMALL_SHARE are large; sorted by
   length they are cut into GROUPS groups of equal cardinality and every length is rounded up to the largest of
   its group;
2. over these few sizes the number of sequences of each configuration (which sizes share a sequence) is optimised
   by a linear program with column generation, and rounded down;
3. actual lengths replace the rounded ones, which frees room; sequences left with more than capacity / LOOSE_SHARE
   free tokens are opened again;
4. what is left, pieces of opened sequences, large remainders and small pieces by falling length, goes where it fits
   best.
Sequences with equal contents are kept as one run with a count, so the plan has a bounded number of entries
whatever the number of documents. Each piece then finds its place from its length and its rank among the pieces of
that length; ranks are counted in a distributed way, so a length that a third of all rows share is no hot spot.
"""

from __future__ import annotations

import bisect
import functools
import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Tokens of a sequence.
CAPACITY = 2048
#: The id after each document.
END = 0
#: Default tokenizer file; a parameter of every function that encodes.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Equal-cardinality groups of the large lengths.
GROUPS = 96
#: Pieces up to capacity / SMALL_SHARE are small.
SMALL_SHARE = 8
#: Sequences keep their configuration if at most capacity / LOOSE_SHARE tokens of them are free.
LOOSE_SHARE = 256
#: The linear program stops within this share of its optimum.
GAP = 5e-4
#: Buckets that the pieces of one length are ranked in.
BUCKETS = 1024
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.cache
def fast_encoding(path: str = TOKENIZER, special: bool = True) -> tiktoken.Encoding:
    """The vocabulary of a byte-level BPE file of the tokenizers library, in the encoder that returns arrays.

    As in the library once the file is loaded, the strings of its added tokens are split off first and get their own
    ids. With special=False they are ordinary text (the library's encode_special_tokens).
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added if special else {})


def token_ids(text: str | None, encoding: tiktoken.Encoding) -> np.ndarray:
    """Ids of one text as little-endian 32-bit numbers."""
    return encoding.encode_to_numpy(text or "", allowed_special="all", disallowed_special=()).astype("<u4", copy=False)


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: one, or the remainder first and then full ones."""
    first = total % capacity or min(total, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, total, capacity)]


def _pieces(path: str, capacity: int):
    def run(batches):
        encoding = fast_encoding(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                out: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.append(token_ids(text.as_py(), encoding), np.uint32(END)).astype("<u4", copy=False)
                    out += [(doc, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut(len(ids), capacity))]
                cols = list(zip(*out, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _knapsack(values: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes within the capacity."""
    layers, best = [], np.zeros(capacity + 1)
    for _ in range(capacity // min(sizes)):
        step, choice = best.copy(), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):
            v = best[: capacity + 1 - s] + values[i]
            better = v > step[s:] + 1e-12
            step[s:][better], choice[s:][better] = v[better], i
        layers.append(choice)
        if (choice < 0).all():
            break
        best = step
    c, use = capacity, np.zeros(len(sizes))
    for choice in reversed(layers):
        if choice[c] >= 0:
            use[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), use


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how many sequences, pieces of each size in one): the linear program's optimum over all configurations, rounded down."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(40 * k):
        level = np.linalg.solve(basis, need)
        price = np.linalg.solve(basis.T, np.ones(k))
        worth, column = _knapsack(np.maximum(price, 0), sizes, capacity)
        if worth <= 1 + GAP:  # the optimum is at most a factor worth below
            break
        turn = np.linalg.solve(basis, column)
        ratio = np.where(turn > 1e-9, np.maximum(level, 0) / np.where(turn > 1e-9, turn, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    level = np.floor(np.maximum(np.linalg.solve(basis, need), 0) + 1e-7).astype(int)
    out, left = [], list(demand)
    for j in np.argsort(-level):
        use = basis[:, j].astype(int).tolist()
        n = min([int(level[j]), *(left[i] // u for i, u in enumerate(use) if u)])
        if n > 0:
            out.append((n, use))
            left = [a - n * u for a, u in zip(left, use, strict=True)]
    return out


class _Pool:
    """Pieces by falling length, taken from the front: segments [length, first rank, count]."""

    def __init__(self):
        self.segments: list[list[int]] = []

    def take(self, n: int) -> list[tuple[int, int, int]]:
        out = []
        while n:
            seg = self.segments[0]
            m = min(n, seg[2])
            out.append((seg[0], seg[1], m))
            seg[1] += m
            seg[2] -= m
            n -= m
            if not seg[2]:
                self.segments.pop(0)
        return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Placement of all pieces from their length histogram, and the number of sequences.

    Rows of the array: length, first rank, count, first sequence, offset. The piece of that length with rank
    first + i goes to sequence first + i at that offset.
    """
    runs: list[list] = [[histogram[capacity], 0, [(capacity, 0)]]] if histogram.get(capacity) else []  # [count, room left, [(length, first rank)]]
    large = [(n, histogram[n]) for n in sorted(histogram, reverse=True) if capacity > n > capacity // SMALL_SHARE]
    small = [(n, histogram[n]) for n in sorted(histogram, reverse=True) if n <= capacity // SMALL_SHARE]
    pools, sizes, demand = [], [], []
    total = sum(c for _, c in large)
    each = max(1, -(-total // groups))
    room = 0
    for n, count in large:
        rank = 0
        while rank < count:
            if not room:
                pools.append(_Pool())
                sizes.append(n)
                demand.append(0)
                room = each
            m = min(room, count - rank)
            pools[-1].segments.append([n, rank, m])
            demand[-1] += m
            rank += m
            room -= m
    same: dict[int, int] = {}
    for s, d in zip(sizes, demand, strict=True):  # groups that round to the same size are one size
        same[s] = same.get(s, 0) + d
    merged = {s: _Pool() for s in same}
    for s, pool in zip(sizes, pools, strict=True):
        merged[s].segments += pool.segments
    if same:
        order = list(same)
        for n, use in configurations(order, [same[s] for s in order], capacity):
            slots = [merged[order[i]].take(n) for i, u in enumerate(use) for _ in range(u)]
            marks = sorted({0, n, *(m for slot in slots for m in np.cumsum([c for *_, c in slot]).tolist())})
            for a, b in zip(marks, marks[1:], strict=False):
                inside = []
                for slot in slots:
                    at = 0
                    for length, rank, c in slot:
                        if at <= a < at + c:
                            inside.append((length, rank + a - at))
                        at += c
                runs.append([b - a, capacity - sum(x for x, _ in inside), inside])
    rest = [(n, r, c) for pool in merged.values() for n, r, c in pool.segments] + [(n, 0, c) for n, c in small]
    rest += [(n, r, run[0]) for run in runs if run[1] > capacity // LOOSE_SHARE for n, r in run[2]]
    runs = [run for run in runs if run[1] <= capacity // LOOSE_SHARE]
    _best_fit(runs, sorted(rest, reverse=True), capacity)
    out, first = [], 0
    for count, _, inside in runs:
        at = 0
        for length, rank in inside:
            out.append((length, rank, count, first, at))
            at += length
        first += count
    return np.array(sorted(out), np.int64).reshape(-1, 5), first


def _best_fit(runs: list[list], rest: list[tuple[int, int, int]], capacity: int) -> None:
    """Place (length, first rank, count) where the least room is left, splitting runs; opens new sequences where nothing fits."""
    by_room: dict[int, list[int]] = {}
    for i, run in enumerate(runs):
        by_room.setdefault(run[1], []).append(i)
    rooms = sorted(by_room)

    def put(i: int) -> None:
        room = runs[i][1]
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append(i)

    for length, rank, count in rest:
        while count:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                m = max(1, count // per)
                per = min(per, count // m)
                runs.append([m, capacity - per * length, [(length, rank + j * m) for j in range(per)]])
                rank += per * m
                count -= per * m
                put(len(runs) - 1)
                continue
            room = rooms[at]
            i = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            run = runs[i]
            m = min(count, run[0])
            if m < run[0]:
                runs.append([run[0] - m, room, [(n, r + m) for n, r in run[2]]])
                put(len(runs) - 1)
            run[0], run[1] = m, room - length
            run[2].append((length, rank))
            rank += m
            count -= m
            put(i)


def _place(table: np.ndarray):
    def run(batches):
        start = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(i), np.int64) for i in (3, 5))
            at = np.searchsorted(start, length << 44 | rank, side="right") - 1
            hit = table[at] if len(table) else np.zeros((0, 5), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(hit[:, 3] + rank - hit[:, 1]), pa.array(hit[:, 4])], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pieces(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids followed by END, cut to the capacity."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.lean(rows).mapInArrow(_pieces(path, capacity), _SCHEMA)


def pack(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (in tokens, gapless from 0).

    A null text is empty and still has its end id; a text of any length is tokenised whole. Repeated rows are packed each for itself; null ids are kept;
    other columns are not read. Empty input gives no rows.
    """
    rows = common.durable(pieces(docs, path, capacity, id_col, text_col).withColumn("bucket", common.by_row(BUCKETS)), "pieces")
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    table, _ = plan(histogram, capacity)
    ranked = common.numbered(rows, ["length"], ["doc_id", "piece"], "rank", "bucket")
    return ranked.mapInArrow(_place(table), f"{_SCHEMA}, sequence_id long, offset long")
