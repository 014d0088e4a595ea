"""Phrase collocations by pattern growth over projected occurrences.

The sequences are the pieces of all texts of a language. Every word occurrence points at itself and the words after it;
the projection of a prefix is the set of occurrences that start with it. Occurrences travel with at most WORDS words,
equal ones of a block as one row with a count, and the rows of a prefix go to one task, sorted, so that each prefix is a
range of rows. There a prefix is extended to the right depth-first: the next word cuts its range into the ranges of its
extensions, and only frequent ones are entered. A range that a batch border cuts is reported with its partial count;
counts are summed once more, so a task holds one batch however long a range is.

Before that, one pass counts words and, by hash, pairs of neighbours. A pair in a hash bucket that is not frequent is not
frequent, so occurrences end before it; the bucket map has a fixed size and only ever drops what cannot count. The same
pass finds all prefixes of one to three words with a large share of the occurrences (there can be few): the occurrences
of such a prefix are dealt by its extensions instead, word by word, so no task gets the share of a hot word or pair.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words of a phrase at most, occurrences at least, phrases of a language returned.
WORDS, FREQUENT, TOP = 4, 30, 2000
#: A phrase goes if a longer candidate around it has at least this share of its occurrences (in percent).
COVERED = 80
#: Score: SCALE * a / (l + r), rounded down.
SCALE = 2_000_000
#: Hash buckets of pairs, as a power of two.
BUCKETS = 24
#: A prefix with more than one of so many occurrences is dealt by its extensions.
SHARE = 2048

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = _LOWER.translate(bytes.maketrans(_BREAKS, b"." * len(_BREAKS)))
_BREAK = b"."
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_COUNT = "kind int, lang string, phrase string, bucket int, n long"
_PAIRS = 0  # kind of bucket rows; kinds 1 to 3 are phrases of so many words


class _Block:
    """The words of some texts of one language as numbers, with a break between pieces."""

    def __init__(self, lang: str, texts: list[str]):
        raw = _BREAK.join(t.encode("utf-8", "surrogatepass") for t in texts).translate(_TABLE)
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        number[_BREAK]
        tokens = raw.replace(_BREAK, b" . ").split()
        self.ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
        self.number, self.size = number, len(number)
        self.words = pa.array([w.decode("utf-8", "replace") for w in number], pa.string())
        seed = zlib.crc32(lang.encode("utf-8", "surrogatepass"))
        self.seed = np.uint64(seed)
        self.hash = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in number), np.uint64, self.size)
        one, two = self.ids[:-1], self.ids[1:]
        self.pair = (one > 0) & (two > 0)  # neighbours of one piece

    def bucket(self, one: np.ndarray, two: np.ndarray, bits: int) -> np.ndarray:
        return ((self.hash[one] * _ODD[0] ^ (self.hash[two] * _ODD[1] + self.seed)) * _ODD[2] >> np.uint64(64 - bits)).astype(np.int64)

    def phrase(self, *columns: np.ndarray) -> pa.Array:
        """Words of numbers joined by a space; the number `size` is no word."""
        parts = [pc.take(self.words, pa.array(c, pa.int64(), mask=c >= self.size)) for c in columns]
        return pc.binary_join_element_wise(*parts, " ", null_handling="skip")


def _blocks(batch: pa.RecordBatch):
    by_lang: defaultdict[str, list[str]] = defaultdict(list)
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        by_lang[lang].append(text)
    for lang, texts in by_lang.items():
        block = _Block(lang, texts)
        if block.size > 1:
            yield lang, block


def _counts(batches, share: int, bits: int):
    """Rows of _COUNT: all words, pairs by bucket, and pairs and triples with a large share of their block."""
    for batch in batches:
        for lang, b in _blocks(batch):
            times = np.bincount(b.ids, minlength=b.size)
            out = [(1, b.words[1:], None, times[1:])]
            at = np.flatnonzero(b.pair)
            code, inverse, times = np.unique(b.ids[at] * b.size + b.ids[at + 1], return_inverse=True, return_counts=True)
            one, two = code // b.size, code % b.size
            bucket, where = np.unique(b.bucket(one, two, bits), return_inverse=True)
            out.append((_PAIRS, None, bucket, np.bincount(where, times).astype(np.int64)))
            heavy = times * share >= len(b.ids)
            out.append((2, b.phrase(one[heavy], two[heavy]), None, times[heavy]))
            rank = np.cumsum(heavy) - 1
            third = np.append(b.ids[2:], [0, 0])[at]
            live = heavy[inverse] & (third > 0)
            triple, times = np.unique(rank[inverse[live]] * b.size + third[live], return_counts=True)
            triple, times = triple[times * share >= len(b.ids)], times[times * share >= len(b.ids)]
            lead = triple // b.size
            out.append((3, b.phrase(one[heavy][lead], two[heavy][lead], triple % b.size), None, times))
            for kind, phrases, buckets, n in out:
                if len(n):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(n), kind), pa.int32()),
                            pa.nulls(len(n), pa.string()) if phrases is None else pa.repeat(pa.scalar(lang, pa.string()), len(n)),
                            pa.nulls(len(n), pa.string()) if phrases is None else phrases,
                            pa.nulls(len(n), pa.int32()) if buckets is None else pa.array(buckets, pa.int32()),
                            pa.array(n, pa.int64()),
                        ],
                        ["kind", "lang", "phrase", "bucket", "n"],
                    )


def _occurrences(batches, frequent: np.ndarray, hot: dict[str, list[str]]):
    """(task, key, hot, n): occurrences as far as their pairs may be frequent; key is lang, line break, words."""
    for batch in batches:
        for lang, b in _blocks(batch):
            good = b.pair & frequent[b.bucket(b.ids[:-1], b.ids[1:], len(frequent).bit_length() - 1)]
            good = np.append(good, [False, False, False])
            at = np.flatnonzero(good)
            if not len(at):
                continue
            none, padded = b.size, np.append(b.ids, [0, 0, 0])
            third = good[at + 1]
            fourth = third & good[at + 2]
            one, two = padded[at], padded[at + 1]
            three, four = np.where(third, padded[at + 2], none), np.where(fourth, padded[at + 3], none)
            head, tail = one * (none + 1) + two, three * (none + 1) + four
            order = np.lexsort((tail, head))
            head, tail = head[order], tail[order]
            new = np.flatnonzero(np.append(True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])))
            n = np.diff(np.append(new, len(head)))
            head, tail = head[new], tail[new]
            one, two, three, four = head // (none + 1), head % (none + 1), tail // (none + 1), tail % (none + 1)

            known = [[b.number.get(w.encode("utf-8", "surrogatepass"), -1) if w else -1 for w in p.split(" ")] for p in hot.get(lang, [])]
            known = [k for k in known if min(k) > 0]
            singles = np.array([k[0] for k in known if len(k) == 1], np.int64)
            pairs = np.sort(np.array([k[0] * (none + 1) + k[1] for k in known if len(k) == 2], np.int64))
            number_of = {c: i for i, c in enumerate(pairs.tolist())}
            triples = np.array([number_of[c] * (none + 1) + k[2] for k in known if len(k) == 3 and (c := k[0] * (none + 1) + k[1]) in number_of], np.int64)
            level = np.isin(one, singles).astype(np.int32)
            level += (level == 1) & np.isin(head, pairs)
            level += (level == 2) & (three < none) & np.isin(np.searchsorted(pairs, head) * (none + 1) + three, triples)
            hashes = np.append(b.hash, np.uint64(0))
            task = hashes[one] * _ODD[0] + b.seed
            task = np.where(level >= 1, (task ^ hashes[two]) * _ODD[1], task)
            task = np.where(level >= 2, (task ^ hashes[three]) * _ODD[2], task)
            task = np.where(level >= 3, (task ^ hashes[four]) * _ODD[3], task)
            key = pc.binary_join_element_wise(pa.scalar(lang, pa.string()), b.phrase(one, two, three, four), "\n")
            yield pa.RecordBatch.from_arrays([pa.array(task.view(np.int64)), key, pa.array(level, pa.int32()), pa.array(n, pa.int64())], ["task", "key", "hot", "n"])


class _Projection:
    """Sorted occurrences of a batch; a prefix is a range of rows."""

    def __init__(self, batch: pa.RecordBatch):
        both = pc.split_pattern(batch.column(1), "\n", max_splits=1, reverse=True)  # no word holds a line break, a language may
        self.lang, self.phrase = pc.list_element(both, 0), pc.list_element(both, 1)
        parts = pc.split_pattern(self.phrase, " ")
        length = pc.list_value_length(parts).to_numpy()
        rows = np.repeat(np.arange(len(length)), length)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(length) - length, length)
        columns = np.full((len(length), WORDS + 1), -1, np.int64)
        columns[:, 0] = self.lang.dictionary_encode().indices.to_numpy()
        columns[rows, place + 1] = pc.list_flatten(parts).dictionary_encode().indices.to_numpy()
        self.rows, self.columns = len(length), columns
        differs = columns[1:] != columns[:-1]
        self.level = np.where(differs.any(axis=1), differs.argmax(axis=1), WORDS + 1)  # first column that differs from the row before
        self.n, self.hot = batch.column(3).to_numpy(), batch.column(2).to_numpy()
        self.found: list[tuple[int, int, int]] = []

    def grow(self, low: int, high: int, words: int) -> None:
        """Extend the prefix of so many words whose occurrences are the rows [low, high) by a word to the right."""
        starts = np.append(low, low + 1 + np.flatnonzero(self.level[low : high - 1] <= words + 1))
        ends = np.append(starts[1:], high)
        sums = np.add.reduceat(self.n[low:high], starts - low)
        enter = (sums >= FREQUENT) | (starts == 0) | (ends == self.rows)
        if words + 1 < WORDS:
            enter |= np.maximum.reduceat(self.hot[low:high], starts - low) > words  # its occurrences are in many tasks
        enter &= self.columns[starts, words + 1] >= 0
        for k in np.flatnonzero(enter).tolist():
            if words:
                self.found.append((int(starts[k]), words + 1, int(sums[k])))
            if words + 1 < WORDS:
                self.grow(int(starts[k]), int(ends[k]), words + 1)


def _grown(batches):
    """(lang, phrase, n) of the prefixes of two words or more that are frequent, or may be together with other rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        p = _Projection(batch)
        borders = np.append(0, 1 + np.flatnonzero(p.level == 0))
        for low, high in zip(borders.tolist(), np.append(borders[1:], p.rows).tolist(), strict=True):
            p.grow(low, high, 0)
        at = pa.array([a for a, _, _ in p.found], pa.int64())
        phrases = [" ".join(x.split(" ")[:w]) for x, (_, w, _) in zip(p.phrase.take(at).to_pylist(), p.found, strict=True)]
        yield pa.RecordBatch.from_arrays([p.lang.take(at), pa.array(phrases, pa.string()), pa.array([n for _, _, n in p.found], pa.int64())], ["lang", "phrase", "n"])


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang, text = F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    return common.lean(docs.where(text.isNotNull() & (text != "")).select(F.coalesce(lang, F.lit("und")).alias("lang"), text.alias("text")))


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", share: int = SHARE, bits: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all phrases of 1 to WORDS words with n >= FREQUENT, and (lang, n) with all words of a language.

    share and bits change where the work is done, never the result.
    """
    texts = _texts(docs, lang_col, text_col)
    keep = (F.col("kind") != _PAIRS) | (F.col("n") >= FREQUENT)
    counts = common.durable(texts.mapInArrow(lambda batches: _counts(batches, share, bits), _COUNT).groupBy("kind", "lang", "phrase", "bucket").agg(F.sum("n").alias("n")).where(keep), "counts")
    words = counts.where("kind = 1")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    every = totals.agg(F.sum("n")).first()[0] or 0
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bucket") % 32)
    packed = counts.where(F.col("kind") == _PAIRS).groupBy(F.col("bucket").bitwiseAND(~31).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most 2^(bits-5) rows
    frequent = np.zeros(1 << bits, bool)
    for k in range(32):
        frequent[packed["at"].to_numpy() + k] = (packed["bits"].to_numpy() >> k & 1).astype(bool)
    hot: dict[str, list[str]] = {}
    # what all blocks below the share hold together is below it: fewer than 2 * share prefixes of each length are left
    for r in counts.where((F.col("kind") != _PAIRS) & (F.col("n") * share >= F.lit(every))).select("lang", "phrase").collect():
        hot.setdefault(r.lang, []).append(r.phrase)
    packed = np.packbits(frequent)

    def project(batches):
        return _occurrences(batches, np.unpackbits(packed).astype(bool), hot)

    dealt = texts.mapInArrow(project, "task long, key string, hot int, n long").repartition("task").sortWithinPartitions("key")
    grown = dealt.mapInArrow(_grown, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    single = words.select("lang", "phrase", "n")
    return common.durable(grown.unionByName(single).where(F.col("n") >= FREQUENT), "phrases"), totals


def _whole(name: str | Column) -> Column:
    return (F.col(name) if isinstance(name, str) else name).cast("decimal(20,0)")


def _key(phrase: Column) -> Column:
    return F.concat_ws("\n", "lang", phrase)


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase of two words or more, by its lowest-scoring cut (of equal ones the first)."""
    parts = F.split("phrase", " ")
    many = frequent.where(F.instr("phrase", " ") > 0)
    cuts = many.select("lang", "phrase", F.col("n").alias("a"), parts.alias("w")).select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    left, right = F.slice("w", F.lit(1), F.col("k")), F.slice("w", F.col("k") + 1, F.size("w"))
    sides = F.array(F.struct(F.lit(True).alias("first"), F.array_join(left, " ").alias("part")), F.struct(F.lit(False).alias("first"), F.array_join(right, " ").alias("part")))
    asked = common.durable(cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.first", _key(F.col("s.part")).alias("key")), "cuts")
    held = common.hot_join(asked, frequent.select(_key(F.col("phrase")).alias("key"), F.col("n").alias("f")), "key")
    of = lambda k, first: F.max(F.when((F.col("k") == k) & (F.col("first") == first), F.col("f")))
    wide = held.groupBy("lang", "phrase", "a").agg(*[of(k, first).alias(f"{'l' if first else 'r'}{k}") for k in range(1, WORDS) for first in (True, False)])
    options = []
    for k in range(1, WORDS):
        l, r = F.col(f"l{k}"), F.col(f"r{k}")
        score = F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * _whole("a"), _whole(l) + _whole(r))
        options.append(F.when(l.isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))))
    best = F.array_min(F.array(*options))  # nulls are passed over
    return wide.select("lang", "phrase", "a", best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def uncovered(candidates: DataFrame) -> DataFrame:
    """candidates (lang, phrase, a, ...) without those that a longer one around them covers."""
    w = F.split("phrase", " ")
    longer = candidates.select("lang", "a", w.alias("w")).where(F.size("w") > 2)
    sized = longer.select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("size"))
    placed = sized.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    inside = placed.select("lang", "a", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    joined = candidates.join(most, ["lang", "phrase"], "left")
    return joined.where(F.col("around").isNull() | (100 * _whole("around") < COVERED * _whole("a"))).drop("around")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP, share: int = SHARE, bits: int = BUCKETS) -> DataFrame:
    """The first `top` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Rows count as they come: repeated rows each, null and empty texts not at all; a null language is `und`; ids are not
    read, nor are other columns; a text of any length is one or more pieces; equal scores are ordered by a, then by the
    phrase's bytes; no rows, or no frequent phrase, give no rows.
    """
    frequent, totals = frequent_phrases(docs, lang_col, text_col, share, bits)
    left = uncovered(scored(frequent)).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)  # a language is no single task's
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
