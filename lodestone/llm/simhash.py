"""SimHash near-duplicates linked by anchor-point covering.

Fingerprint: ASCII-lower-cased words split at ASCII white space, three-word shingles with repeats, XXH64 with
seed 42, a bit set where over half the hashes have it.

Linking all fingerprints at Hamming distance 2 or less: the anchors are the words of a covering code, the product
of two perfect [23,12] Golay codes (covering radius 3 each) and a perfect [15,11] Hamming code (radius 1) over 61
of the 64 bits: 2^35 anchors. For two fingerprints within the threshold of 2 there is a point within 1 of both,
and that point has an anchor within the covering radius; so both lie within radius plus 1 of it. Each side
therefore carries half the threshold, and every fingerprint is replicated to all anchors within covering radius
plus 1 (about 16 rows) instead of one side carrying all of it (about 150 rows); the pairs met are the same. The
comparison runs per anchor, once for each distinct fingerprint, so exact copies cost nothing.

A tight cluster of many different fingerprints can crowd one anchor. The members of an anchor with more than
CROWD fingerprints go to the finest covering code instead, where every point is an anchor (radius 0): each is
replicated to its 65 points within distance 1, no anchor can hold more than 65, and each anchor links its members
to the least one. That is exact as well, and linear in the members.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Differing bits at most; the replication below is built for it.
THRESHOLD = 2
#: Fingerprints at one anchor beyond which they are linked over the finest code.
CROWD = 512
_CHUNK = 1 << 16
_GOLAY, _HAMMING = 0xC75, 0x13  # generator polynomials (fixed values)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of one text; 0 without words, one shingle of all words if fewer than three."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    shingles = zip(words, words[1:], words[2:], strict=False) if len(words) > 2 else iter([words])
    sums, left = np.zeros(64, np.int64), n
    while left:
        take = min(left, _CHUNK)
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, (s for s, _ in zip(shingles, range(take), strict=False)) if n > _CHUNK else shingles), repeat(42)), np.uint64, take)
        sums += _bit_counts(h)
        left -= take
    bits = sums * 2 > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    rows = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros(64, np.int64)
    for i in range(0, len(rows), 255):  # sums of up to 255 bits fit a byte
        out += rows[i : i + 255].sum(axis=0, dtype=np.uint8)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _fingerprints(batches):
    for batch in batches:
        seen: dict[str | None, int] = {}
        fps = []
        for text in batch.column(1):
            t = text.as_py()
            fp = seen.get(t)
            if fp is None:
                fp = _signed(fingerprint(t))
                if t is None or len(t) < 20_000:
                    seen[t] = fp
            fps.append(fp)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; one row per input row, other columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.lean(rows).mapInArrow(_fingerprints, "doc_id long, fp long")


def _remainder(v: int, poly: int) -> int:
    top = poly.bit_length()
    while v.bit_length() >= top:
        v ^= poly << (v.bit_length() - top)
    return v


def _cosets(n: int, poly: int, radius: int) -> tuple[list[list[int]], list[list[int]]]:
    """By syndrome: the error patterns of weight up to radius (one, as the code is perfect), and of weight radius + 1."""
    near: dict[int, list[int]] = defaultdict(list)
    next_: dict[int, list[int]] = defaultdict(list)
    for weight in range(radius + 2):
        for bits in combinations(range(n), weight):
            v = sum(1 << b for b in bits)
            (near if weight <= radius else next_)[_remainder(v, poly)].append(v)
    size = 1 << (poly.bit_length() - 1)
    assert all(len(near[s]) == 1 for s in range(size))
    return [near[s] for s in range(size)], [next_[s] for s in range(size)]


class Cover:
    """Anchors of the product code near a fingerprint."""

    def __init__(self):
        self.blocks = [(0, 23, _GOLAY), (23, 23, _GOLAY), (46, 15, _HAMMING)]
        tables = {_GOLAY: _cosets(23, _GOLAY, 3), _HAMMING: _cosets(15, _HAMMING, 1)}
        self.tables = [tables[poly] for _, _, poly in self.blocks]
        self.unit = [[_remainder(1 << b, poly) for b in range(n)] for _, n, poly in self.blocks]

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in fps, anchor) for all anchors within covering radius plus 1 of each fingerprint."""
        u = fps.astype(np.int64).view(np.uint64)
        parts, homes, syndromes = [], [], []
        for (at, n, _), unit, (near, _) in zip(self.blocks, self.unit, self.tables, strict=True):
            v = ((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)
            s = np.zeros(len(v), np.int64)
            for b, x in enumerate(unit):
                s ^= np.where((v >> b) & 1, x, 0)
            parts.append(v)
            syndromes.append(s)
            homes.append(v ^ np.array([p[0] for p in near], np.int64)[s])
        home = homes[0] | homes[1] << 23 | homes[2] << 46
        at_all, anchors = [np.arange(len(u))], [home]
        for k, (shift, _, _) in enumerate(self.blocks):  # one block one further out, the others at home
            further = self.tables[k][1]
            count = np.array([len(p) for p in further], np.int64)
            start = np.concatenate([[0], np.cumsum(count)])[:-1]
            flat = np.array([x for p in further for x in p], np.int64)
            m = count[syndromes[k]]
            i = np.repeat(np.arange(len(u)), m)
            within = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
            other = parts[k][i] ^ flat[start[syndromes[k]][i] + within]
            at_all.append(i)
            anchors.append(home[i] ^ (homes[k][i] << shift) ^ (other << shift))
        return np.concatenate(at_all), np.concatenate(anchors)


def _replicate(batches):
    cover = Cover()
    for batch in batches:
        fps = np.asarray(batch.column(0), np.int64)
        for i in range(0, len(fps), 8192):
            part = fps[i : i + 8192]
            at, anchors = cover.anchors(part)
            yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(part[at])], ["anchor", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """(a, b): distinct pairs a <> b of the distinct fingerprints in column fp whose graph joins all at distance <= 2.

    Every pair at distance 2 or less is either in the result or joined by links of it through their anchor's least.
    """
    copies = common.durable(fps.mapInArrow(_replicate, "anchor long, fp long"), "replicas")
    crowded = copies.groupBy("anchor").count().where(F.col("count") > CROWD).select("anchor")
    crowded = common.durable(crowded, "crowded")
    calm = copies.join(crowded, "anchor", "left_anti") if not crowded.isEmpty() else copies
    near = (F.col("a.anchor") == F.col("b.anchor")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= THRESHOLD)
    found = calm.alias("a").join(calm.alias("b"), near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    if not crowded.isEmpty():
        members = copies.join(crowded, "anchor", "left_semi").select("fp").distinct()
        flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
        points = members.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
        stars = points.groupBy("point").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))  # 65 at most
        found = found.union(stars.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b"))
    return found.distinct()


def _roots(fps: DataFrame) -> DataFrame:
    """(fp, root) of the distinct fingerprints in column fp; root names the component."""
    return fps.join(common.components(links(fps)).toDF("fp", "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))  # fp is unique on both sides


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows stay repeated. A null
    doc_id is kept and never chosen as component_id unless a component holds nothing else. Empty input: no rows.
    """
    rows = common.durable(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = common.durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    whole = common.durable(classes.join(_roots(classes.select("fp")), "fp"), "roots")
    least = common.durable(whole.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = common.durable(common.hot_join(whole, least, "root").select("fp", "component_id"), "named")  # a component may hold any share
    return common.hot_join(rows, named, "fp").select(  # and so may a text
"doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, its own columns: the one with the least doc_id, of repeated rows any one.

    Null ids come last within a component. Fingerprints are taken once; texts are shuffled once, by row number.
    """
    names = docs.columns
    at = names.index(text_col)
    mark, number = common.fresh(names, "__fp"), common.fresh(names, "__row")

    def run(batches):
        for batch in batches:
            fps = [_signed(fingerprint(t.as_py())) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], [*names, mark])

    rows = common.lean(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(mark, T.LongType())])).withColumn(number, F.monotonically_increasing_id())
    rows = common.durable(rows, "rows")  # row numbers hold from here on
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(number).alias("row"))
    classes = common.durable(rows.groupBy(F.col(mark).alias("fp")).agg(F.min(first).alias("first")), "classes")
    kept = classes.join(_roots(classes.select("fp")), "fp").groupBy("root").agg(F.min("first").alias("first"))
    return rows.join(kept.select(F.col("first.row").alias(number)), number, "left_semi").select(*names)
