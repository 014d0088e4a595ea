"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

A text is split by the public pattern; the distinct pieces of a chunk are encoded together. Pieces of similar
length form one padded matrix of token ids. Each round every row merges its leftmost minimum-rank pair: pair
ranks come from a hashed pair table, the merged column is dropped by compaction (each live row loses exactly one
element, so the matrix just gets narrower), and rows without a pair to merge leave. In wide matrices a row merges the
repeats of its pair in the same round. A match of the pattern always ends before a space that follows a character other
than white space, so texts are cut there and the ids of such chunks are kept in a bounded cache per Python worker.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Default rank file; a parameter of every function that encodes.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Bytes of a piece beyond which a round merges all repeats of a row's pair at once; the ids are the same.
WIDE = 192
#: Characters that a worker's cache holds, about; it starts anew beyond that.
CACHE = 6_000_000
#: Characters of text that are split at a time.
SPAN = 1 << 20
_ROWS, _CELLS = 1 << 13, 1 << 21
_PAD, _NONE = 0xFFFF, np.int32(2**31 - 1)

_EXACT = regex.compile(public_tokenizers.PATTERN)
#: The same split in the faster standard module, for texts of characters on which both agree.
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_LOOSE = re.compile(r"\s ")


@functools.cache
def _odd() -> re.Pattern:
    """Characters on which the two modules may class differently, and all from U+3000 on."""
    kinds = [(re.compile(a), regex.compile(b)) for a, b in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s"), (r"[^\s\w]|_", r"[^\s\p{L}\p{N}]"))]
    bad = [c for c in map(chr, range(0x3000)) if any(bool(a.match(c)) != bool(b.match(c)) for a, b in kinds)]
    return re.compile("[" + "".join(map(re.escape, bad)) + "　-\U0010ffff]")


_CHUNK_CUT = re.compile(r"(?<=\S) ")


class Vocabulary:
    """Ranks, token bytes and the hashed pair table of one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {r: t for t, r in self.ranks.items()}
        if len(self.ranks) >= _PAD:
            raise ValueError("ids must fit 16 bits")
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, ranks = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 16 | b)
                    ranks.append(rank)
        self.bits = max(4, (8 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, 0xFFFFFFFF, np.uint32)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        left, rank = np.array(keys, np.uint32), np.array(ranks, np.int32)
        slot = self._hash(left)
        while len(left):  # open addressing: of those that want a free slot, one gets it; the rest move on
            free = self.keys[slot] == 0xFFFFFFFF
            _, first = np.unique(slot, return_index=True)
            won = np.zeros(len(left), bool)
            won[first] = True
            won &= free
            self.keys[slot[won]], self.values[slot[won]] = left[won], rank[won]
            left, rank, slot = left[~won], rank[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, _NONE where there is none."""
        keys = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        slot = self._hash(keys)
        out = self.values[slot]
        held = self.keys[slot]
        rest = np.flatnonzero(held != keys)
        if len(rest):
            out[rest] = _NONE
            rest = rest[held[rest] != 0xFFFFFFFF]
            at = slot[rest]
            while len(rest):
                at = (at + 1) & ((1 << self.bits) - 1)
                held = self.keys[at]
                hit = held == keys[rest]
                out[rest[hit]] = self.values[at[hit]]
                go = ~hit & (held != 0xFFFFFFFF)
                rest, at = rest[go], at[go]
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece."""
        out: list[bytes] = [b""] * len(words)
        todo: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            else:
                n = len(w)
                step = 1 if n <= 16 else 4 if n <= WIDE else 1 << (n.bit_length() - 3)
                todo.setdefault(-(-n // step) * step, []).append(i)
        for width, members in todo.items():
            rows, bucket = max(1, min(_ROWS, _CELLS // width)), self._encode_bucket if width <= WIDE else self._encode_wide
            for k in range(0, len(members), rows):
                bucket(words, members[k : k + rows], width, out)
        return out

    def _matrix(self, words: list[bytes], members: list[int], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Padded byte ids of the pieces, a row each, and their sizes."""
        raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in members), np.uint8).reshape(-1, width)
        size = np.array([len(words[i]) for i in members])
        ids = self.single[raw]
        if size.min() < width:
            ids[np.arange(width) >= size[:, None]] = _PAD
        return ids, size

    def _encode_bucket(self, words: list[bytes], members: list[int], width: int, out: list[bytes]) -> None:
        rows = np.array(members)
        ids, size = self._matrix(words, members, width)
        ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while True:
            j = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), j] if ranks.shape[1] else np.full(len(rows), _NONE)
            done = best == _NONE
            if done.any():
                final, n = ids[done].astype("<u4"), size[done]
                flat, step = final.tobytes(), 4 * ids.shape[1]
                for at, (row, m) in enumerate(zip(rows[done].tolist(), n.tolist(), strict=True)):
                    out[row] = flat[at * step : at * step + 4 * m]
                live = ~done
                if not live.any():
                    return
                rows, ids, ranks, size, j, best = rows[live], ids[live], ranks[live], size[live], j[live], best[live]
            r, n, w = np.arange(len(rows)), len(rows), ids.shape[1]
            ids[r, j] = best
            keep = np.ones((n, w), bool)
            keep[r, j + 1] = False
            ids = ids[keep].reshape(n, w - 1)
            keep = np.ones((n, w - 1), bool)
            keep[r, j] = False
            ranks = ranks[keep].reshape(n, w - 2)
            size = size - 1
            if w > 2:
                left = np.flatnonzero(j > 0)
                ranks[left, j[left] - 1] = self.pair_ranks(ids[left, j[left] - 1], ids[left, j[left]])
                right = np.flatnonzero(j < w - 2)
                ranks[right, j[right]] = self.pair_ranks(ids[right, j[right]], ids[right, j[right] + 1])

    def _encode_wide(self, words: list[bytes], members: list[int], width: int, out: list[bytes]) -> None:
        """The same rounds for long pieces: a row merges, with its leftmost minimum-rank pair, the pair's repeats.

        The repeats are what the following rounds would merge, up to and with the first merge that makes a pair of
        lower rank beside it. Merged cells are left out by links, and the matrix is compacted once a quarter is out.
        """
        rows = np.array(members)
        ids, size = self._matrix(words, members, width)
        while len(rows):
            w = int(size.max())
            n = len(rows)
            cells = np.full((n, w + 1), _PAD, np.int32)
            cells[:, :w] = ids[:, :w]
            after = np.tile(np.arange(1, w + 2, dtype=np.int32), (n, 1))
            after[np.arange(n), size - 1] = w
            before = np.tile(np.arange(-1, w, dtype=np.int32), (n, 1))
            before[:, 0] = w
            ranks = np.full((n, w + 1), _NONE, np.int32)
            ranks[:, :-2] = self.pair_ranks(cells[:, :-2].ravel(), cells[:, 1:-1].ravel()).reshape(n, w - 1)
            dead = np.zeros((n, w), bool)
            dead[np.arange(w) >= size[:, None]] = True
            live = np.ones(n, bool)
            while live.any() and int(size[live].max()) * 4 > 3 * w:
                best = ranks.min(axis=1)
                live = best != _NONE
                r, j = np.nonzero((ranks == best[:, None]) & live[:, None])
                if not len(r):
                    break
                # of hits that share a cell every second one stands, from the left
                chained = np.zeros(len(r), bool)
                chained[1:] = (r[1:] == r[:-1]) & (after[r[:-1], j[:-1]] == j[1:])
                at = np.arange(len(r))
                stand = (at - np.maximum.accumulate(np.where(chained, 0, at))) % 2 == 0
                r, j = r[stand], j[stand]
                k, new = after[r, j], best[r]
                left, right = before[r, j], after[r, k]
                joined = np.zeros(len(r), bool)  # the left neighbour is the merge before
                joined[1:] = (r[1:] == r[:-1]) & (k[:-1] == left[1:])
                lower = np.minimum(self.pair_ranks(np.where(joined, new, cells[r, left]), new), self.pair_ranks(new, cells[r, right])) < new
                count = np.cumsum(lower) - lower  # lower pairs made by earlier merges, then only those of the same row
                first = np.maximum.accumulate(np.where(np.r_[True, r[1:] != r[:-1]], np.arange(len(r)), 0))
                go = count == count[first]
                r, j, k, new, right = r[go], j[go], k[go], new[go], right[go]
                cells[r, j], ranks[r, k], dead[r, k] = new, _NONE, True
                after[r, j] = right
                inside = right < w
                before[r[inside], right[inside]] = j[inside]
                ranks[r, j] = self.pair_ranks(new, cells[r, after[r, j]])
                left = before[r, j]
                inside = left < w
                ranks[r[inside], left[inside]] = self.pair_ranks(cells[r[inside], left[inside]], cells[r[inside], j[inside]])
                size = size - np.bincount(r, minlength=n)
            kept = ~dead
            flat = cells[:, :w][kept]
            ends = np.cumsum(size)
            for i in np.flatnonzero(~live):
                out[rows[i]] = flat[ends[i] - size[i] : ends[i]].astype("<u4").tobytes()
            width_left = int(size[live].max()) if live.any() else 0
            ids = np.full((n, max(1, width_left)), _PAD, np.int32)
            row = np.repeat(np.arange(n), size)
            place = np.arange(len(flat)) - np.repeat(ends - size, size)
            fits = place < ids.shape[1]
            ids[row[fits], place[fits]] = flat[fits]
            rows, ids, size = rows[live], ids[live], size[live]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a list of ids."""
        return b"".join(map(self.bytes.__getitem__, ids))


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Texts to ids with a bounded cache of chunks: what stands before the first cut, and what follows a space."""

    def __init__(self, path: str = RANKS):
        self.vocabulary = vocabulary(path)
        self.caches: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.held = 0

    def _chunks(self, text: str) -> list[str] | None:
        """The text cut at spaces after other characters; None if characters need the exact split."""
        if _odd().search(text):
            return None
        return _CHUNK_CUT.split(text) if _LOOSE.search(text) else text.split(" ")

    def _learn(self, texts: list[list[str]]) -> None:
        """Encode the chunks that the caches do not hold, all their pieces together."""
        if self.held > CACHE:
            self.caches, self.held = ({}, {}), 0
        head, tail = self.caches
        firsts = {parts[0] for parts in texts}.difference(head)
        rest: set[str] = set()
        for parts in texts:
            rest.update(parts[1:])
        rest.difference_update(tail)
        split = [_FAST.findall(c) for c in firsts] + [_FAST.findall(" " + c) for c in rest]
        words = list({w for parts in split for w in parts})
        ids = dict(zip(words, self.vocabulary.encode([w.encode("utf-8", "surrogatepass") for w in words]), strict=True))
        made = [ids[parts[0]] if len(parts) == 1 else b"".join([ids[w] for w in parts]) for parts in split]
        head.update(zip(firsts, made, strict=False))
        tail.update(zip(rest, made[len(firsts) :], strict=True))
        self.held += sum(map(len, firsts)) + sum(map(len, rest))

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """The little-endian 32-bit ids of each text, in order; a null text is empty. Texts are taken in groups of bounded size."""
        group: list[list[list[str]]] = []
        held = 0
        for text in texts:
            if text and len(text) > SPAN:  # alone, a span at a time
                yield from self._drain(group)
                group, held = [], 0
                yield b"".join(b"".join(self._drain([[part]])) for part in self._parts(text))
                continue
            group.append([*self._parts(text or "")])
            held += len(text or "")
            if held > SPAN:
                yield from self._drain(group)
                group, held = [], 0
        yield from self._drain(group)

    def _parts(self, text: str) -> Iterator[list]:
        """Spans of bounded size, each as [chunks, None] or [None, pieces]."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > SPAN and (m := _CUT.search(text, at + SPAN)):  # a match always ends before such a space
                end = m.start()
            part = text[at:end] if at or end < len(text) else text
            chunks = self._chunks(part)
            yield [chunks, None if chunks is not None else _EXACT.findall(part)]
            at = end
    def _drain(self, group: list[list[list]]) -> Iterator[bytes]:
        self._learn([chunks for parts in group for chunks, _ in parts if chunks is not None])
        head, tail = self.caches
        odd = list({w for parts in group for _, pieces in parts if pieces is not None for w in pieces})
        ids = dict(zip(odd, self.vocabulary.encode([w.encode("utf-8", "surrogatepass") for w in odd]), strict=True))
        for parts in group:
            yield b"".join([head[c[0]] + b"".join(map(tail.__getitem__, c[1:])) if c is not None else b"".join(map(ids.__getitem__, pieces)) for c, pieces in parts])


@functools.cache
def encoder(path: str = RANKS) -> Encoder:
    """The worker's encoder for a rank file."""
    return Encoder(path)


def strings(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def _digests(path: str):
    def run(batches):
        enc = encoder(path)
        decimal = {i: b"%d" % i for i in enc.vocabulary.bytes}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, ids_sha, text_sha = [], [], []
                for raw in enc.encode_all(strings(part.column(1))):
                    ids = np.frombuffer(raw, "<u4").tolist()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest())
                    text_sha.append(hashlib.sha256(enc.vocabulary.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [np.frombuffer(raw, "<i4") for raw in enc.encode_all(strings(part.column(1)))]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                values = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "ids"])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return common.lean(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))


def encode(docs: DataFrame, path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row; a null text has no ids."""
    return _texts(docs, id_col, text_col).mapInArrow(_ids(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, text binary) from (doc_id, ids); null ids give null."""

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            out = [None if x is None else words.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def digests(docs: DataFrame, path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (bytes that the ids decode to).

    One row per input row, repeats and null ids included; a null text counts as empty; other columns are not read.
    """
    return _texts(docs, id_col, text_col).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


