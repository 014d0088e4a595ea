"""Recall: gated vector and text candidates of whole query sets, fused by reciprocal rank."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import bounded
from ..functions import scoring

#: Queries that one pass over the chunks scores, at most.
QUERY_BLOCK = 10_000
#: Chunks whose token counts are held at a time, and about how many of their characters, and of the matches in them.
_ROWS, _CHARS = 512, 1 << 20
#: Queries whose distances to a batch of vectors, or scores in a part of it, are held at a time.
_TILE = 256
#: Cells of the matrix by which texts are left out that cannot be among the best, at most; larger question sets do without.
_BOUND = 1 << 20


def gate(chunks: DataFrame, areas: list[str] | None = None, document_ids: list[int] | None = None, parent_ids: list[int] | None = None) -> DataFrame:
    """Children of ready documents, in the given areas, documents and parents (None: no filter)."""
    out = chunks.where("status = 'ready'")
    for column, allowed in (("area_id", areas), ("document_id", document_ids), ("parent_id", parent_ids)):
        if allowed is not None:
            out = out.where(F.col(column).isin(allowed))
    return out


def ranked(df: DataFrame, by: list[str], order: list, out: str, limit: int | None = None) -> DataFrame:
    """Row numbers within `by`; with a limit only those up to it (Spark prunes before the shuffle)."""
    df = df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return df if limit is None else df.where(F.col(out) <= limit)


def numbered(df: DataFrame, by: list[str], id_col: str, order: list, out: str, width: int = 1 << 16) -> DataFrame:
    """Row numbers within `by`, ordered by id_col (an integer), then `order`, where a key may hold most rows.

    Rows are numbered within ranges of `width` ids, and the ranges of a key by their counts: a task sorts the rows of
    `width` ids at most, and one window sees a row a range.
    """
    r = df.withColumn("__range", F.floor(F.col(id_col) / width))
    counts = r.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__range")) - F.col("__n")
    starts = counts.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__at"), before.alias("__before"))
    same = F.col("__range").eqNullSafe(F.col("__at"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    within = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(id_col, *order))
    return r.withColumn("__within", within).join(starts, same).select(*df.columns, (F.col("__before") + F.col("__within")).alias(out))


def _bounded(queries: DataFrame, columns: list[str]) -> list:
    rows = queries.select(*columns).limit(QUERY_BLOCK + 1).collect()
    if len(rows) > QUERY_BLOCK:
        raise ValueError(f"more than {QUERY_BLOCK} queries: recall them in blocks")
    return rows


def in_blocks(queries: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """answer(queries), where it takes QUERY_BLOCK of them at most: larger sets are cut by a hash of the id, and each block is
    a reading of the chunks of its own."""
    n = queries.count()
    if n <= QUERY_BLOCK:
        return answer(queries)
    blocks = -(-n * 5 // (4 * QUERY_BLOCK))  # four fifths full, so that none overflows
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return functools.reduce(DataFrame.unionByName, [answer(queries.where(part == k)) for k in range(blocks)])


def vector_recall(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, distance, vector_rank): the k nearest by cosine distance, ties to the smaller key.

    chunks: key, embedding; queries: query_id, embedding; more than QUERY_BLOCK go in blocks. Every Arrow batch is scored against all
    queries by one matrix product and keeps its k best, so only query x batch x k rows meet in the ranking.
    """
    return in_blocks(queries, lambda some: _vector_block(chunks, some, k, key))


def _vector_block(chunks: DataFrame, queries: DataFrame, k: int, key: str) -> DataFrame:
    asked = _bounded(queries, ["query_id", "embedding"])
    qids = np.array([r[0] for r in asked], np.int64)
    q = np.array([list(r[1]) for r in asked], np.float64)
    unit = q / np.maximum(np.sqrt((q * q).sum(axis=1)), 1e-300)[:, None] if len(asked) else q

    def run(batches):
        for batch in batches:
            ids, vectors = np.asarray(batch.column(0), np.int64), batch.column(1)
            if not len(ids) or not len(qids):
                continue
            x = np.asarray(vectors.flatten(), np.float64).reshape(len(ids), -1)
            norm = np.sqrt((x * x).sum(axis=1))
            x = x / np.where(norm == 0, 1, norm)[:, None]
            for first in range(0, len(qids), _TILE):  # a tile of queries at a time bounds the matrix of distances
                d = np.round(1 - unit[first : first + _TILE] @ x.T, 12) + 0.0
                out = []
                for i, row in enumerate(d):
                    near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if len(ids) > k else np.arange(len(ids))
                    best = near[np.lexsort((ids[near], row[near]))[:k]]
                    out.append((np.full(len(best), qids[first + i]), ids[best], row[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", key, "distance"])

    found = bounded(chunks.where("embedding is not null").select(F.col(key).cast("long"), "embedding")).mapInArrow(run, f"query_id long, {key} long, distance double")
    return ranked(found, ["query_id"], ["distance", key], "vector_rank", k)


def text_scores(chunks: DataFrame, queries: DataFrame, key: str = "chunk_id", text: str = "content", k: int | None = None) -> DataFrame:
    """(query_id, key, score) where the score is positive: occurrences of the query's tokens, repeats counted again.

    Occurrences of a token do not overlap. Tokens of all queries are counted in one reading of some hundred chunks at a
    time, and scored by matrix products over the tokens that occur there. With k every task returns only its k
    best for each query, ties to the smaller key. More than QUERY_BLOCK queries go in blocks.
    """
    return in_blocks(queries, lambda some: _text_block(chunks, some, key, text, k))


def _parts(batch: pa.RecordBatch):
    """(ids, lower-case texts) of a batch, _ROWS rows and about _CHARS characters at a time."""
    ids, texts, size, first = np.asarray(batch.column(0), np.int64), [], 0, 0
    for row, text in enumerate(batch.column(1)):
        texts.append((text.as_py() or "").lower())
        size += len(texts[-1])
        if len(texts) == _ROWS or size >= _CHARS or row == len(ids) - 1:
            yield ids[first : row + 1], texts
            texts, size, first = [], 0, row + 1


def _apart(end: np.ndarray, token: np.ndarray, size: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which matches count, where those of a token must not overlap: the first, and each that begins after the last counted one.

    end, token: matches in the order of the text; last: where each token's last counted match ended, brought up to date.
    """
    keep = np.ones(len(end), bool)
    order = np.lexsort((end, token))
    e, t = end[order], token[order]
    new = np.concatenate(([True], t[1:] != t[:-1])) if len(t) else np.zeros(0, bool)
    near = np.unique(t[e - np.where(new, last[t], np.concatenate((e[:1], e[:-1]))) < size[t]])
    tight = np.isin(t, near)
    last[t[~tight]] = e[~tight]
    for i in np.flatnonzero(tight):
        if e[i] - last[t[i]] >= size[t[i]]:
            last[t[i]] = e[i]
        else:
            keep[order[i]] = False
    return keep


class TokenCounter:
    """Counts tokens in texts: those of one or two characters, which are most matches, by their codes, longer ones by one automaton."""

    def __init__(self, tokens: list[str]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(tokens):
            if len(t) > 2:
                self.automaton.add_word(t, i)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.short = []
        for n in 1, 2:
            own = sorted((sum(ord(c) << 21 * (n - 1 - j) for j, c in enumerate(t)), i) for i, t in enumerate(tokens) if len(t) == n)
            if own:
                keys, place = np.array(own, np.int64).T
                maybe = np.zeros(1 << 16, bool)
                maybe[self._low(keys)] = True
                self.short.append((n, keys, place, maybe))
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.loops = np.array([any(t.startswith(t[i:]) for i in range(1, len(t))) for t in tokens], bool)  # may overlap themselves

    @staticmethod
    def _low(keys: np.ndarray) -> np.ndarray:
        return (keys ^ keys >> 17) & 0xFFFF

    def _matches(self, text: str):
        """(ends, tokens) of the matches, about _CHARS at a time, those of a token in the order of the text."""
        found = self.automaton.iter(text) if len(self.automaton) else iter(())
        while len(m := np.fromiter(itertools.chain.from_iterable(itertools.islice(found, _CHARS)), np.int64).reshape(-1, 2)):
            yield m[:, 0], m[:, 1]
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        for at in range(0, len(code) if self.short else 0, _CHARS):
            here = code[at : at + _CHARS + 1].astype(np.int64)
            for n, keys, place, maybe in self.short:
                key = here[:_CHARS] if n == 1 else here[:-1] << 21 | here[1:]
                hit = np.flatnonzero(maybe[self._low(key)])
                near = np.minimum(np.searchsorted(keys, key[hit]), len(keys) - 1)
                same = keys[near] == key[hit]
                yield hit[same] + at + n - 1, place[near[same]]

    def cells(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, text, occurrences) where there are any; a long text may have several rows of a token, to be added up.
        Tokens hold no white space, so the texts are searched as one."""
        starts = np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])
        last, cells, times = np.full(len(self.size), -(1 << 60)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for end, token in self._matches("\n".join(texts)):
            keep = np.ones(len(end), bool)
            own = np.flatnonzero(self.loops[token])
            keep[own] = _apart(end[own], token[own], self.size, last)
            cell, n = np.unique(token[keep] * len(texts) + np.searchsorted(starts, end[keep], "right") - 1, return_counts=True)
            cells.append(cell)
            times.append(n)
        cell = np.concatenate(cells)
        return cell // len(texts), cell % len(texts), np.concatenate(times)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens that occur, occurrences of each in each text)."""
        token, text, n = self.cells(texts)
        used, at = np.unique(token, return_inverse=True)
        return used, np.bincount(at * len(texts) + text, n, len(used) * len(texts)).reshape(len(used), len(texts))


class ScoreBound:
    """What texts can score at most. The tokens that end at one place of a text are suffixes of the longest of them, so a place
    adds no more than the suffixes of a token that can end there, going by the last three characters.

    Characters count as one of `classes`: places are told apart by three, two or one of them, as long as the tokens are.
    """

    def __init__(self, asked: list[dict[str, int]], classes: int = 64):
        letters = sorted({c for mine in asked for t in mine for c in t[-3:]})
        self.letter = np.zeros(0x110000, np.uint8)
        for i, c in enumerate(letters):
            self.letter[ord(c)] = 1 + i % (classes - 1)  # 0: in no token's end
        most: list[dict[tuple, int]] = []
        for mine in asked:
            sizes, ends = {len(t) for t in mine}, {}
            for t in mine:
                end = tuple(int(self.letter[ord(c)]) for c in t[-3:])
                ends[end] = max(ends.get(end, 0), sum(mine.get(t[-n:], 0) for n in sizes if n <= len(t)))
            most.append(ends)
        known = sorted({e for ends in most for e in ends}, key=lambda e: (len(e), e))  # longer ends last: they go before their own
        self.slots = 1 + len(known)
        self.slot = np.zeros((classes, classes, classes), np.int32)
        for i, e in enumerate(known):
            self.slot[(..., *e)] = 1 + i
        self.most = np.zeros((len(asked), self.slots)) if self.fits(len(asked)) else None
        for q, ends in enumerate(most if self.most is not None else []):
            for i, e in enumerate(known):
                self.most[q, 1 + i] = max(ends.get(e[n:], 0) for n in range(len(e)))

    def fits(self, queries: int) -> bool:
        return queries * self.slots <= _BOUND

    def reach(self, texts: list[str], least: np.ndarray) -> np.ndarray:
        """Which texts may score something, and not less than `least`, for a query."""
        code = self.letter[np.frombuffer("\n\n".join(["", *texts]).encode("utf-32-le"), np.uint32)]
        place = self.slot[code[:-2], code[1:-1], code[2:]]
        row = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])[: len(place)]
        times = np.bincount(row * self.slots + place, minlength=len(texts) * self.slots).reshape(len(texts), self.slots)
        live = np.zeros(len(texts), bool)
        for first in range(0, len(self.most), _TILE):
            live |= (times @ self.most[first : first + _TILE].T >= np.maximum(least[first : first + _TILE], 1)).any(axis=1)
        return live


def _bound(asked: list[dict[str, int]]) -> ScoreBound | None:
    """The finest bound that is small enough."""
    return next((b for b in (ScoreBound(asked, n) for n in (64, 16)) if b.most is not None), None)


def _text_block(chunks: DataFrame, queries: DataFrame, key: str, text: str, k: int | None) -> DataFrame:
    asked: dict[int, dict[str, int]] = {}
    for r in _bounded(queries, ["query_id", "query_text"]):
        mine = asked.setdefault(r[0], {})
        for token in (r[1] or "").lower().split():
            mine[token] = mine.get(token, 0) + 1
    tokens = sorted({t for mine in asked.values() for t in mine})
    place = {t: i for i, t in enumerate(tokens)}
    qids = np.array(list(asked), np.int64)
    pairs = [(i, place[t], n) for i, mine in enumerate(asked.values()) for t, n in mine.items()]
    of, what, weight = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else [np.zeros(0, np.int64)] * 3

    def scores(used, count):
        """(first query, scores of a tile of queries in the texts)."""
        slot = np.full(len(tokens), -1)
        slot[used] = np.arange(len(used))
        for first in range(0, len(qids), _TILE):
            begin, end = np.searchsorted(of, [first, first + _TILE])
            here = np.flatnonzero(slot[what[begin:end]] >= 0) + begin
            w = np.zeros((min(_TILE, len(qids) - first), len(used)))
            w[of[here] - first, slot[what[here]]] = weight[here]
            yield first, w @ count

    bound = _bound(list(asked.values())) if k is not None and tokens else None

    def rows(query, ids, score):
        return pa.RecordBatch.from_arrays([pa.array(qids[query]), pa.array(ids), pa.array(score.astype(np.int32))], ["query_id", key, "score"])

    def run(batches):
        counter = TokenCounter(tokens) if tokens else None
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, id, score: of the rows so far, k a query
        least = np.zeros(len(qids))  # the k-th best score so far: what scores less cannot be among the k best
        for batch in batches if counter else ():
            for ids, texts in _parts(batch):
                if bound is not None:
                    live = np.flatnonzero(bound.reach(texts, least))
                    ids, texts = ids[live], [texts[i] for i in live]
                    if not texts:
                        continue
                new = []
                for first, score in scores(*counter.counts(texts)):
                    query, row = np.nonzero((score > 0) & (score >= least[first : first + len(score), None]))
                    new.append((query + first, ids[row], score[query, row]))
                if k is None:
                    yield from (rows(*n) for n in new)
                    continue
                query, found, score = (np.concatenate(x) for x in zip(best, *new, strict=True))
                order = np.lexsort((found, -score, query))
                rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
                order, rank = order[rank < k], rank[rank < k]
                best = [query[order], found[order], score[order]]
                least[best[0][rank == k - 1]] = best[2][rank == k - 1]
        if len(best[0]):
            yield rows(*best)

    return bounded(chunks.select(F.col(key).cast("long"), text)).mapInArrow(run, f"query_id long, {key} long, score int")


def text_recall(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(query_id, key, score, fts_rank): the k best by score, ties to the smaller key."""
    return ranked(text_scores(chunks, queries, key, text, k), ["query_id"], [F.desc("score"), key], "fts_rank", k)


def found(vector: DataFrame, text: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The candidates of both lists, with their ranks in each: at most two lists of k rows a question."""
    return vector.join(text, ["query_id", key], "full_outer")


def fuse(vector: DataFrame, text: DataFrame, details: DataFrame, k: int = 60, limit: int = 30, key: str = "chunk_id", ties: list[str] | None = None) -> DataFrame:
    """Candidates of both lists, see fused()."""
    return fused(found(vector, text, key), details, k, limit, key, ties)


def fused(found: DataFrame, details: DataFrame, k: int = 60, limit: int = 30, key: str = "chunk_id", ties: list[str] | None = None) -> DataFrame:
    """found() with rrf_score and rrf_rank up to the limit; details (key and its columns) gives the tie keys.

    Order: score, best rank, then `ties` (default position and key). Scores are compared at twelve decimals.
    """
    both = F.broadcast(found).join(details, key)  # at most two lists of k rows for QUERY_BLOCK queries; chunks stay where they are
    score = F.round(scoring.rrf(F.col("vector_rank"), F.col("fts_rank"), k=k), 12)
    both = both.withColumn("rrf_score", score).withColumn("best_rank", scoring.best_rank(F.col("vector_rank"), F.col("fts_rank")))
    source = F.when(F.col("vector_rank").isNotNull() & F.col("fts_rank").isNotNull(), "hybrid").when(F.col("vector_rank").isNotNull(), "vector").otherwise("fts")
    return ranked(both.withColumn("source", source), ["query_id"], [F.desc("rrf_score"), "best_rank", *(ties or ["position", key])], "rrf_rank", limit)


def hybrid(chunks: DataFrame, queries: DataFrame, vector_k: int = 30, text_k: int = 30, limit: int = 30, rrf_k: int = 60) -> DataFrame:
    """Gated chunks (with embedding, content, position...) to fused candidates of all queries (query_id, query_text, embedding)."""
    details = chunks.drop("embedding", "vec_id")
    return fuse(vector_recall(chunks, queries, vector_k), text_recall(chunks, queries, text_k), details, rrf_k, limit)


def by_synopsis(items: DataFrame, queries: DataFrame, k: int, key: str, ties: list[str], rrf_k: int = 60) -> DataFrame:
    """Documents or sections by their synopsis: both recalls of k over items (key, synopsis, embedding, columns of ties), fused, the k best."""
    details = items.drop("embedding", "synopsis", "vec_id")
    return fuse(vector_recall(items, queries, k, key), text_recall(items, queries, k, key, "synopsis"), details, rrf_k, k, key, ties)


def select_documents(found: DataFrame, mentions: DataFrame, k: int, key: str = "document_id") -> DataFrame:
    """(query_id, key, select_rank, strategy): the documents that a query names, in their order, then recalled ones up to k.

    found: by_synopsis(); mentions: query_id, query_type, summary_scope, resolved (array of keys). Fact lookups select nothing
    (no rows); a single-document summary that names one document takes it alone; at least one recalled document follows
    the named ones even if these are k already.
    """
    asked = mentions.where("query_type <> 'fact_lookup'")
    alone = (F.coalesce(F.col("summary_scope") == "single_document", F.lit(False))) & (F.size("resolved") == 1)
    named = asked.select("query_id", F.posexplode("resolved").alias("at", key)).select("query_id", key, F.lit(0).alias("stage"), F.col("at").alias("o"))
    recalled = found.join(F.broadcast(asked.where(~alone).select("query_id")), "query_id").select("query_id", key, F.lit(1).alias("stage"), F.col("rrf_rank").alias("o"))
    first = named.unionByName(recalled).groupBy("query_id", key).agg(F.min(F.struct("stage", "o")).alias("m"))
    rank = ranked(first, ["query_id"], ["m"], "select_rank")
    rule = F.broadcast(asked.select("query_id", F.greatest(F.lit(k), F.size("resolved") + 1).alias("most"), F.when(alone, "mention_resolved_single_document_v1").otherwise("synopsis_rrf_v1").alias("strategy")))
    return rank.join(rule, "query_id").where("select_rank <= most").select("query_id", key, "select_rank", "strategy")
