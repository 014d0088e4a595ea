"""Ranking policy and per-parent reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectorised
from .recall import ranked


def apply_policy(candidates: DataFrame) -> DataFrame:
    """candidates (query_id, query_text, rrf_score, rrf_rank, best_rank, heading, content) with policy_score and policy_rank."""
    score = F.round(vectorised.policy_scores("rrf_score", "query_text", "heading", "content"), 12)
    return ranked(candidates.withColumn("policy_score", score), ["query_id"], [F.desc("policy_score"), "rrf_rank", "best_rank", "chunk_id"], "policy_rank")


def budget(base: int, hits: Column) -> Column:
    """Characters of a rerank document: twice the base for two hit children, two and a half times from three on, 5000 at most."""
    return F.least(F.when(hits >= 3, F.lit(base * 5 // 2)).when(hits == 2, F.lit(base * 2)).otherwise(F.lit(base)), F.greatest(F.lit(5000), F.lit(base))).cast("int")


def _bundle(kids: Column) -> Column:
    """The hit children one by one, numbered."""
    return F.array_join(F.transform(kids, lambda t, i: F.concat(F.lit("[Hit child "), i + 1, F.lit("]\n"), t)), "\n\n")


def _cut_bundle(kids: Column, chars: Column) -> Column:
    """The numbered children cut to so many characters in all: each may use its share of what the ones before left."""
    n = F.size(kids)
    label = lambda i: F.concat(F.lit("[Hit child "), i + 1, F.lit("]\n"))
    frame = F.aggregate(F.transform(kids, lambda t, i: F.length(label(i))), F.lit(0), lambda s, x: s + x) + 2 * (n - 1)
    room = chars - frame

    def add(state: Column, kid: Column) -> Column:
        share = F.greatest(F.lit(1), F.floor(state["room"] / (n - state["i"])).cast("int"))
        part = text.clipped(kid, share)
        joint = F.when(state["i"] > 0, "\n\n").otherwise("")
        return F.struct((state["i"] + 1).alias("i"), (state["room"] - F.length(part)).alias("room"), F.concat(state["out"], joint, label(state["i"]), part).alias("out"))

    made = F.aggregate(kids, F.struct(F.lit(0).alias("i"), room.alias("room"), F.lit("").alias("out")), add, lambda s: s["out"])
    return text.clipped(F.when(room <= 0, _bundle(kids)).otherwise(made), chars)


def rerank_text(heading: Column, content: Column, contents: Column, max_chars: int = 2000) -> Column:
    """Heading and content within the budget; if the content is too long and several children were hit, the children's shares of it."""
    kids = F.filter(F.transform(contents, text.strip), lambda t: t != "")
    whole = budget(max_chars, F.size(kids))
    prefix = text.strip(F.concat(F.lit("Header: "), text.strip(F.coalesce(heading, F.lit("")))))
    room = whole - F.length(prefix) - len("\nContent:\n")
    bundle = _bundle(kids)
    body = (
        F.when(room <= 0, "").when(F.length(content) <= room, content).when(F.size(kids) <= 1, F.substring(content, F.lit(1), room))
        .when(F.length(bundle) <= room, bundle).otherwise(_cut_bundle(kids, room))
    )
    return F.substring(text.strip(F.concat(prefix, F.lit("\nContent:\n"), body)), F.lit(1), whole)


def parent_groups(candidates: DataFrame, order: str = "policy_rank", max_chars: int = 2000) -> DataFrame:
    """One row per (query, document, parent, kind): the first order, the hit children in the order of the document, the
    first heading that is not empty, and the text to rerank. A query has a bounded number of candidates."""
    names = [c for c in ("rrf_rank", "vector_rank", "fts_rank", "source") if c in candidates.columns]
    index = F.coalesce("child_index", F.lit(-1)).alias("index")
    hit = F.struct(index, "position", "chunk_id", "content", "heading", "start_offset", "end_offset", F.col(order).alias("order"), *names)
    parent = F.coalesce("parent_id", "chunk_id").alias("parent_id")
    groups = candidates.groupBy("query_id", "document_id", parent, "structure_kind").agg(F.min(order).alias("first_order"), F.first("query_text").alias("query_text"), F.sort_array(F.collect_list(hit)).alias("hits"))
    part = lambda name: F.transform("hits", lambda x: x[name])
    groups = groups.withColumn("heading", F.get(F.filter(part("heading"), lambda h: h != ""), F.lit(0)))
    return groups.withColumn("rerank_text", vectorised.rerank_texts(max_chars)("structure_kind", "heading", part("content")))


def candidate_id() -> Column:
    return F.concat_ws(":", F.col("document_id").cast("string"), F.col("parent_id").cast("string"), "structure_kind")


def apply_rerank(groups: DataFrame, top_n: int = 30, score: Column | None = None) -> DataFrame:
    """groups with rerank_score, rerank_applied, fallback_reason and group_rank.

    The first top_n groups are scored (default: the deterministic provider) and ordered by score, ties by first order;
    a null score is `missing_score` and keeps its place after them; groups beyond top_n keep their order at the end.
    """
    tried = F.col("tried") <= top_n
    value = score if score is not None else vectorised.rerank_scores("query_text", candidate_id(), "rerank_text")
    out = ranked(groups, ["query_id"], ["first_order", "document_id", "parent_id"], "tried")
    out = out.withColumn("rerank_score", F.when(tried, F.round(value, 12))).withColumn("rerank_applied", F.col("rerank_score").isNotNull())
    out = out.withColumn("fallback_reason", F.when(tried & ~F.col("rerank_applied"), "missing_score"))
    return ranked(out, ["query_id"], [F.desc("rerank_applied"), F.desc_nulls_last("rerank_score"), "tried"], "group_rank").drop("tried")


def by_parent(groups: DataFrame) -> DataFrame:
    """Reranked groups to one row per (query, document, parent): text and table hits of a parent are selected together.

    group_rank is the better one; hits keep the order of the groups and carry the rank of theirs (null if not applied).
    """
    rank = F.when(F.col("rerank_applied"), F.col("group_rank"))
    hits = F.transform("hits", lambda h, i: F.struct(F.col("group_rank").alias("o"), i.alias("i"), F.struct(h["chunk_id"].alias("chunk_id"), h["index"].alias("child_index"), h["content"].alias("content"), h["heading"].alias("heading"), h["start_offset"].alias("start_offset"), h["end_offset"].alias("end_offset"), *[h[c].alias(c) for c in ("rrf_rank", "vector_rank", "fts_rank", "source")], F.col("structure_kind").alias("structure_kind"), rank.alias("rerank_rank")).alias("hit")))
    rows = groups.select("query_id", "query_text", "document_id", "parent_id", "group_rank", hits.alias("hits"))
    out = rows.groupBy("query_id", "document_id", "parent_id").agg(F.min("group_rank").alias("group_rank"), F.first("query_text").alias("query_text"), F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"))
    return out.withColumn("hits", F.transform("hits", lambda x: x["hit"]))


def document_rounds(groups: DataFrame, order: str = "group_rank") -> DataFrame:
    """groups with doc_round (place among the document's groups) and doc_first (the document's first order)."""
    w = Window.partitionBy("query_id", "document_id")
    return groups.withColumn("doc_round", F.row_number().over(w.orderBy(order))).withColumn("doc_first", F.min(order).over(w))
