"""Approximate nearest neighbours by inner product over a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is then assigned to a leaf. Inner product becomes distance by
one more coordinate (the missing length up to the longest vector). A query walks the tree best bin first through a
priority queue. A bin's promise is the query's product with its centre plus `width` times its radius; inner nodes
promise no less than any leaf below them, so leaves come in order of promise. The width is calibrated: for sampled
queries the exact answer is computed against all rows, and it is widened until the share of true neighbours whose
leaf promises enough reaches the target. Visits widen round by round, four times as many leaves each; a query goes
on while a leaf promises as much as its k-th best score so far, so a query in a dense cluster ends early and one in
empty space looks far. From the second round on only vectors that beat the k-th best score are returned, a few dozen
a query and round whatever the table's size.

Leaves of any size are cut into chunks, and the queries of a leaf into blocks, so that a task only ever holds one
bounded chunk and one bounded block; equal vectors of a chunk are scored once.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors that the tree is fitted on, at most; those with the smallest id hashes.
SAMPLE = 32_768
#: Children of a node, rows of a leaf on average (as far as the sample allows), sampled vectors of a leaf at least.
BRANCH, LEAF_ROWS, LEAF_SAMPLE = 16, 256, 8
#: Queries that calibrate the width, and the recall they must reach.
CALIBRATION, TARGET = 192, 0.96
#: Leaves of the first round; each round visits up to four times as many.
FIRST = 4
#: Vectors of a chunk and queries of a block, about.
CHUNK, BLOCK = 2048, 1024
_SEED = 20_221


@dataclass
class Tree:
    """Flat arrays: a node's centre, and its children's range; leaf[i] is the leaf's number or -1; radius of leaves."""

    centres: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaf: np.ndarray
    longest: float
    radius: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Rows with the coordinate that turns inner product into distance."""
        return np.column_stack([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest child on every level."""
        y, node = self.lift(x), np.zeros(len(x), np.int64)
        while True:
            open_ = np.unique(node[self.leaf[node] < 0])
            if not len(open_):
                return self.leaf[node]
            for n in open_:
                at = np.flatnonzero(node == n)
                a, b = self.first[n], self.last[n]
                node[at] = a + _nearest(y[at], self.centres[a:b])

    def reach(self, width: float) -> np.ndarray:
        """How far beyond its centre each node may promise: width radii for a leaf, what covers the children above."""
        out = width * self.radius
        for n in range(len(self.leaf) - 1, -1, -1):  # children come after their parent
            if self.leaf[n] < 0:
                a, b = self.first[n], self.last[n]
                gap = np.sqrt(((self.centres[a:b, :-1] - self.centres[n, :-1]) ** 2).sum(axis=1))
                out[n] = (gap + out[a:b]).max()
        return out

    def visits(self, q: np.ndarray, reach: np.ndarray, count: int, least: float = -np.inf) -> list[int]:
        """The first leaves of a best-bin-first walk, at most `count`, that promise a score of `least`."""
        length = float(np.sqrt(q @ q))
        queue, out = [(-np.inf, 0)], []
        while queue and len(out) < count:
            promise, n = heapq.heappop(queue)
            if -promise < least:
                break
            if self.leaf[n] >= 0:
                out.append(int(self.leaf[n]))
                continue
            a, b = int(self.first[n]), int(self.last[n])
            for i, x in enumerate((self.centres[a:b, :-1] @ q + length * reach[a:b]).tolist()):
                heapq.heappush(queue, (-x, a + i))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    norms = (centres * centres).sum(axis=1)
    for i in range(0, len(x), 8192):
        out[i : i + 8192] = (norms - 2 * x[i : i + 8192] @ centres.T).argmin(axis=1)
    return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres[np.unique(_nearest(x, centres))]


def build(sample: np.ndarray, longest: float, rows: int) -> Tree:
    """The tree of a sample drawn from so many rows; leaves hold LEAF_ROWS of them on average."""
    tree = Tree(np.zeros((1, 1)), np.zeros(1), np.zeros(1), np.zeros(1), longest, np.zeros(1))
    y = tree.lift(sample)
    small = max(LEAF_SAMPLE, math.ceil(len(y) * LEAF_ROWS / max(rows, 1)))
    rng = np.random.default_rng(_SEED)
    centres, first, last, leaf = [y.mean(axis=0)], [0], [0], [-1]
    spread: dict[int, tuple[float, int]] = {}
    todo, leaves = [(0, np.arange(len(y)))], 0
    while todo:
        node, members = todo.pop(0)
        kids = _kmeans(y[members], min(BRANCH, max(2, len(members) // small)), rng) if len(members) > small else []
        if len(kids) < 2:
            leaf[node] = leaves
            leaves += 1
            off = ((y[members] - centres[node]) ** 2).sum(axis=1)
            spread[node] = (float(np.sqrt(off.mean())) if len(members) else 0.0, len(members))
            continue
        near = _nearest(y[members], kids)
        first[node], last[node] = len(centres), len(centres) + len(kids)
        for i, c in enumerate(kids):
            centres.append(c)
            first.append(0)
            last.append(0)
            leaf.append(-1)
            todo.append((len(centres) - 1, members[near == i]))
    usual = float(np.median([r for r, _ in spread.values()]))
    radius = np.zeros(len(centres))
    for node, (r, n) in spread.items():  # too few sampled vectors say nothing about a leaf's radius
        radius[node] = r if n >= 4 else max(r, usual)
    return Tree(np.array(centres), np.array(first), np.array(last), np.array(leaf), longest, radius)


def _usable(v: str) -> Column:
    """Vectors that take part: not null, all components finite, not all zero."""
    c = F.col(v)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return c.isNotNull() & finite & F.exists(c, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def best(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of each query's k best of these vectors, its own left out, ties to smaller ids.

    With `least`, only scores from there on. Equal vectors are scored once. A first product picks what can be among
    the best up to rounding; the score itself is the exactly rounded sum of the components' products, the same
    wherever the vector stands.
    """
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    _, lead, which = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel() if len(x) else np.zeros(0), return_index=True, return_inverse=True)
    group: list[list[int]] = [[] for _ in lead]
    of_id: list[dict[int, int]] = [{} for _ in lead]
    for i, (g, v) in enumerate(zip(which.ravel().tolist(), ids.tolist(), strict=True)):
        held = of_id[g]
        if held.get(v, 0) < k and len(group[g]) - max(held.values(), default=0) < k:  # k are left whichever id is the query's own
            group[g].append(i)
            held[v] = held.get(v, 0) + 1
    reps = x[lead]
    rough = q @ reps.T
    slack = 1e-12 * np.sqrt((q * q).sum(axis=1)) * (np.sqrt((reps * reps).sum(axis=1).max()) if len(reps) else 0.0)
    edge = np.full(len(q), -np.inf)
    if len(reps) > k + 1:
        edge = np.partition(rough, len(reps) - k - 1, axis=1)[:, len(reps) - k - 1]
    if least is not None:
        edge = np.maximum(edge, least)
    out: list[tuple] = []
    rows, cols = np.nonzero(rough >= (edge - slack)[:, None])
    ends = np.searchsorted(rows, np.arange(len(q) + 1))
    for i in range(len(q)):
        found = []
        for g in cols[ends[i] : ends[i + 1]].tolist():
            score = math.fsum((q[i] * reps[g]).tolist())
            if least is None or score >= least[i]:
                found += [(-score, int(ids[m])) for m in group[g] if ids[m] != qids[i]]
        out += [(qids[i], v, -s) for s, v in heapq.nsmallest(k, found)]
    return tuple(np.array(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _scored(batch_ids, ids, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(batch_ids, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])


_SCORED = "query_id long, vec_id long, score double"


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(vectors: DataFrame, qids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """The exact answer for a stated, bounded set of queries against all rows (vec_id, embedding), in blocks."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                yield _scored(*best(np.asarray(part.column(0), np.int64), _matrix(part.column(1)), qids, q, k))

    return _top(vectors.select("vec_id", "embedding").mapInArrow(run, _SCORED), k)


def _local(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = df.collect()
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, 1))
    return np.array([r[0] for r in rows], np.int64), np.array([list(r[1]) for r in rows], np.float64)


def calibrate(vectors: DataFrame, queries: DataFrame, tree: Tree, k: int, target: float = TARGET) -> float:
    """The least width at which so large a share of the sampled queries' true neighbours stands in leaves that promise
    their k-th best score."""
    qids, q = _local(queries.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION))
    if not len(qids):
        return 0.0
    best_ = F.broadcast(common.durable(exact(vectors, qids, q, k), "truth"))  # CALIBRATION * k rows
    truth = vectors.select("vec_id", "embedding").join(best_, "vec_id").groupBy("query_id", "vec_id", "score").agg(F.min("embedding").alias("embedding")).collect()
    if not truth:
        return 0.0
    at = {int(i): n for n, i in enumerate(qids)}
    leaf_node = np.argsort(np.where(tree.leaf < 0, len(tree.leaf), tree.leaf), kind="stable")[: tree.leaves]
    node = leaf_node[tree.assign(np.array([list(r.embedding) for r in truth], np.float64))]
    kth: dict[int, float] = {}
    for r in truth:
        kth[r.query_id] = min(kth.get(r.query_id, np.inf), r.score)
    mine = q[[at[r.query_id] for r in truth]]
    short = np.array([kth[r.query_id] for r in truth]) - (mine * tree.centres[node, :-1]).sum(axis=1)
    need = np.maximum(short, 0) / np.maximum(tree.radius[node] * np.sqrt((mine * mine).sum(axis=1)), 1e-9)
    return float(np.sort(need)[math.ceil(target * len(need)) - 1]) * (1 + 1e-9)


def search(table: DataFrame, queries: Column | str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row for which `queries` (of id_col) holds.

    Candidates are all rows with other ids; scores are inner products in double precision; ties go to the smaller
    vec_id; with fewer candidates all are returned. Null, zero and non-finite vectors and null ids take no part. Rows
    repeated with one id are candidates each for itself; as a query such an id asks once, with the first of its vectors
    by content. Vectors of different lengths have no product: each length is searched for itself (the usual table has
    one). Without rows or queries the result is empty.
    """
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where(F.col("vec_id").isNotNull() & _usable("embedding"))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("square")).orderBy("size").collect()  # a row a length
    out = None
    for r in sizes:
        found = _search(rows.where(F.size("embedding") == r["size"]), queries, k, target, r.n, math.sqrt(r.square) * (1 + 1e-9))
        out = found if out is None else out.unionByName(found)
    return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _search(rows: DataFrame, queries: Column | str, k: int, target: float, n: int, longest: float) -> DataFrame:
    """The search among n rows (vec_id, embedding) of one length, none longer than `longest`."""
    asked = common.durable(rows.where(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "asked")
    _, sample = _local(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE))
    tree = build(sample, longest, n)

    def leaf_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.assign(_matrix(batch.column(1))), pa.int32())], ["vec_id", "embedding", "leaf"])

    kind = rows.schema["embedding"].dataType.simpleString()
    vectors = common.durable(rows.mapInArrow(leaf_of, f"vec_id long, embedding {kind}, leaf int"), "vectors")  # leaves are assigned once
    reach = tree.reach(calibrate(vectors, asked, tree, k, target))

    def per_leaf(df, size):
        count = np.zeros(tree.leaves, np.int64)
        for r in df.groupBy("leaf").count().collect():  # a row a leaf
            count[r.leaf] = r["count"]
        return -(-count // size)

    chunks = per_leaf(vectors, CHUNK)
    found, visited = common.durable(asked.select(F.col("vec_id").alias("query_id"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("double").alias("score")).limit(0), "found"), 0
    while visited < tree.leaves:
        upto = FIRST if not visited else 4 * visited
        kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        live = common.durable(asked.join(kth, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))).mapInArrow(_visits(tree, reach, visited, upto), _LIVE), "visits")
        if live.isEmpty():
            break
        merged = found.select("query_id", "vec_id", "score").unionByName(_round(vectors, live, chunks, per_leaf(live.select(F.explode("leaves").alias("leaf")), BLOCK), k))
        after = common.durable(_top(merged, k), "found")
        common.release(found)
        common.release(live)
        found, visited = after, upto
    return found.select("query_id", "rank", "vec_id", "score")


_LIVE = "vec_id long, embedding array<double>, least double, leaves array<int>"


def _visits(tree: Tree, reach: np.ndarray, done: int, upto: int):
    """Each query with the leaves of its walk after the first `done` ones; queries without any are through."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            least = np.asarray(batch.column(2), np.float64)
            seen = [tree.visits(v, reach, upto, s)[done:] for v, s in zip(x, least, strict=True)]
            on = [i for i, s in enumerate(seen) if s]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(on, pa.int64())), pa.array([x[i] for i in on], pa.list_(pa.float64())), pa.array(least[on], pa.float64()), pa.array([seen[i] for i in on], pa.list_(pa.int32()))], ["vec_id", "embedding", "least", "leaves"]
            )

    return run


def _mixed(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def _round(vectors: DataFrame, live: DataFrame, chunks: np.ndarray, blocks: np.ndarray, k: int) -> DataFrame:
    """Scores of the live queries in their leaves: every chunk of a leaf meets every block of its queries once.

    A leaf without live queries has no blocks, so its vectors do not leave the scan.
    """
    start = np.concatenate([[0], np.cumsum(chunks * blocks)])

    def spread(ids, row, leaf, own, others):
        """Row numbers and cells: the row's own chunk (or block), with all blocks (or chunks) of the leaf."""
        times = others[leaf]
        at = np.repeat(np.arange(len(row)), times)
        other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        return row[at], leaf[at], (_mixed(ids)[row] % own[leaf])[at], other

    def cells_of_vectors(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            row, leaf, chunk, block = spread(ids, np.arange(len(ids)), np.asarray(batch.column(2), np.int64), chunks, blocks)
            if len(row):
                yield _cells(batch, row, start[leaf] + chunk * blocks[leaf] + block)

    def cells_of_queries(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(3)
                row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths(), np.int64))
                row, leaf, block, chunk = spread(np.asarray(part.column(0), np.int64), row, np.asarray(lists.flatten(), np.int64), blocks, chunks)
                yield _cells(part, row, start[leaf] + chunk * blocks[leaf] + block)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_scored([], [], [])])
        a, b = left.combine_chunks(), right.combine_chunks()
        flat = lambda t: _matrix(t.column("embedding").combine_chunks())
        return pa.Table.from_batches([_scored(*best(np.asarray(a.column("vec_id"), np.int64), flat(a), np.asarray(b.column("vec_id"), np.int64), flat(b), k, np.asarray(b.column("least"), np.float64)))])

    here = vectors.mapInArrow(cells_of_vectors, f"cell long, vec_id long, embedding {vectors.schema['embedding'].dataType.simpleString()}")
    there = live.mapInArrow(cells_of_queries, "cell long, vec_id long, embedding array<double>, least double")
    return here.groupBy("cell").cogroup(there.groupBy("cell")).applyInArrow(meet, _SCORED)


def _cells(batch: pa.RecordBatch, row: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
    kept = batch.take(pa.array(row))
    extra = [i for i, name in enumerate(kept.schema.names) if name == "least"]
    return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), kept.column(0), kept.column(1), *(kept.column(i) for i in extra)], ["cell", "vec_id", "embedding", *("least" for _ in extra)])
