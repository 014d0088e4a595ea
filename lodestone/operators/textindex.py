"""Text recall from an inverted index, without reading chunk texts again.

A token of a query has no white space, so all its occurrences in a text lie inside the words between white space. The
index therefore keeps words only: the postings (block, words, chunk ids and occurrences of each), a table bucketed by
block, where a block is some thousands of chunks, and the lexicon (word, chunks that hold it, occurrences). A search finds the
words of a block that hold a token, and scores the block by matrix products; nothing but the k best of each block and query
is shuffled.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import bounded
from ..sources.scratch import folder
from .recall import QUERY_BLOCK, TokenCounter, in_blocks, ranked

#: Chunks of a block, about, and buckets of the postings.
BLOCK, BUCKETS = 4096, 64
#: Tokens whose occurrences one matrix product holds, and words that a row of the postings holds.
_TILE, _ROW = 512, 64


@dataclass(frozen=True)
class TextIndex:
    """Names of the tables of an index."""

    postings: str
    lexicon: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.postings)

    def words(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.lexicon)


_POSTINGS = "block int, words string, sizes array<int>, chunk_ids array<long>, times array<int>"


def _postings(table: pa.Table) -> pa.Table:
    """The postings of a block from its texts, _ROW words a row."""
    held = Counter()
    for chunk, text in zip(table.column("chunk_id").to_pylist(), table.column("text"), strict=True):
        for word, n in Counter((text.as_py() or "").lower().split()).items():
            held[word, chunk] += n
    where: dict[str, list[int]] = {}
    for word, chunk in held:
        where.setdefault(word, []).append(chunk)
    words, out = sorted(where), [[], [], [], []]
    for at in range(0, len(words), _ROW):
        some = words[at : at + _ROW]
        lists = [sorted(where[w]) for w in some]
        for column, value in zip(out, (" ".join(some), [len(x) for x in lists], [c for x in lists for c in x], [held[w, c] for w, x in zip(some, lists, strict=True) for c in x]), strict=True):
            column.append(value)
    kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    block = pa.array([table.column("block")[0].as_py()] * len(out[0]), pa.int32())
    return pa.table([block, *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [x.split()[0] for x in _POSTINGS.split(", ")])


def _totals(batches):
    for batch in batches:
        out: list[tuple] = []
        for words, sizes, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            ends = np.cumsum([0, *sizes])
            out += zip(words.split(" "), sizes, np.add.reduceat(times, ends[:-1]).tolist(), strict=True)
        columns = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int64(), pa.int64()], strict=True)], ["word", "chunks", "occurrences"])


def build(chunks: DataFrame, name: str | None = None, key: str = "chunk_id", text: str = "content", block: int = BLOCK, buckets: int = BUCKETS) -> TextIndex:
    """Write the index of chunks (key, text) as tables under the folder that driver and executors share.

    A chunk's block is a hash of its key, so that blocks are even however ids run. Null texts have no words; repeated keys add up.
    """
    spark = chunks.sparkSession
    name = name or f"text_index_{uuid.uuid4().hex[:12]}"
    at = folder(spark, name)
    rows = bounded(chunks.select(F.col(key).cast("long").alias("chunk_id"), F.col(text).cast("string").alias("text")))
    n_blocks = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(n_blocks)).cast("int"))
    buckets = min(buckets, n_blocks)
    # one shuffle, of the texts, which are a fraction of their words' rows; blocks and buckets are dealt by the same hash
    postings = dealt.repartition(buckets, "block").groupBy("block").applyInArrow(_postings, _POSTINGS)  # at most a block's chunks
    postings.write.bucketBy(buckets, "block").option("path", f"{at}/postings").saveAsTable(f"{name}_postings")
    totals = bounded(spark.table(f"{name}_postings").select("words", "sizes", "times")).mapInArrow(_totals, "word string, chunks long, occurrences long")
    lexicon = totals.groupBy("word").agg(F.sum("chunks").alias("chunks"), F.sum("occurrences").alias("occurrences"))
    lexicon.write.option("path", f"{at}/lexicon").saveAsTable(f"{name}_lexicon")
    return TextIndex(f"{name}_postings", f"{name}_lexicon")


def drop(spark: SparkSession, index: TextIndex) -> None:
    for t in (index.postings, index.lexicon):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def matching_words(lexicon: DataFrame, tokens: list[str]) -> DataFrame:
    """(word, token, n): lexicon words that hold a token, with its occurrences that do not overlap."""
    place = {t: i for i, t in enumerate(tokens)}

    def run(batches):
        automaton = ahocorasick.Automaton()
        for t in tokens:
            automaton.add_word(t, (place[t], len(t)))
        if tokens:
            automaton.make_automaton()
        for batch in batches:
            out: list[tuple] = []
            for word in batch.column(0).to_pylist() if tokens else ():
                last: dict[int, int] = {}
                n: Counter = Counter()
                for end, (token, size) in automaton.iter(word):
                    if end - size >= last.get(token, -1):
                        last[token] = end
                        n[token] += 1
                out += [(word, token, times) for token, times in n.items()]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int32(), pa.int32()], strict=True)], ["word", "token", "n"])

    return lexicon.select("word").mapInArrow(run, "word string, token int, n int")


def _weights(queries: DataFrame) -> tuple[list[int], list[str], list[dict[str, int]]]:
    rows = queries.select("query_id", "query_text").limit(QUERY_BLOCK + 1).collect()
    if len(rows) > QUERY_BLOCK:
        raise ValueError(f"more than {QUERY_BLOCK} queries: search them in blocks")
    asked = [(r[0], Counter((r[1] or "").lower().split())) for r in rows]
    return [q for q, _ in asked], sorted({t for _, c in asked for t in c}), [c for _, c in asked]


def search(spark: SparkSession, index: TextIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, fts_rank): the k best by occurrences of the query's tokens, ties to the smaller key.

    queries: query_id, query_text; more than QUERY_BLOCK go in blocks. The same rows as recall.text_recall over the chunks.
    """
    return in_blocks(queries, lambda some: _search_block(spark, index, some, k))


def _search_block(spark: SparkSession, index: TextIndex, queries: DataFrame, k: int) -> DataFrame:
    ids, tokens, asked = _weights(queries)
    place = {t: i for i, t in enumerate(tokens)}
    pairs = [(q, place[t], n) for q, c in enumerate(asked) for t, n in c.items()]
    weight = np.zeros((len(ids), len(tokens)))
    for q, t, n in pairs:
        weight[q, t] = n
    made: list[TokenCounter] = []  # a task's

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        if tokens and not made:
            made.append(TokenCounter(tokens))
        chunks, where = np.unique(np.concatenate(frame["chunk_ids"].to_list()), return_inverse=True)
        times = np.concatenate(frame["times"].to_list())
        first = np.cumsum([0, *np.concatenate(frame["sizes"].to_list())])
        token, word, held = made[0].cells(" ".join(frame["words"]).split(" ")) if tokens else [np.zeros(0, np.int64)] * 3
        order = np.argsort(token, kind="stable")
        word, token, held = word[order], token[order], held[order]
        score = np.zeros((len(ids), len(chunks)))
        for low in range(0, len(tokens), _TILE):  # occurrences of some tokens in all chunks of the block at a time
            begin, end = np.searchsorted(token, [low, low + _TILE])
            w = word[begin:end]
            size = first[w + 1] - first[w]
            at = np.repeat(first[w] - np.cumsum(size) + size, size) + np.arange(size.sum())
            cell = np.repeat(token[begin:end] - low, size) * len(chunks) + where[at]
            count = np.bincount(cell, times[at] * np.repeat(held[begin:end], size), minlength=_TILE * len(chunks)).reshape(_TILE, -1)
            some = weight[:, low : low + _TILE]
            score += some @ count[: some.shape[1]]
        out = []
        for q, row in enumerate(score):
            near = np.flatnonzero(row)
            if len(near) > k:
                near = near[row[near] >= np.partition(row[near], len(near) - k)[len(near) - k]]
                near = near[np.lexsort((chunks[near], -row[near]))[:k]]
            out.append(pd.DataFrame({"query_id": ids[q], "chunk_id": chunks[near], "score": row[near].astype(np.int32)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})

    found = index.rows(spark).groupBy("block").applyInPandas(best, "query_id long, chunk_id long, score int")
    return ranked(found, ["query_id"], [F.desc("score"), "chunk_id"], "fts_rank", k)
