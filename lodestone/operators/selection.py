"""Diversified selection of parent groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recall import ranked
from .rerank import document_rounds

def select_ranked(groups: DataFrame, max_contexts: int) -> DataFrame:
    """The first groups in order: fact lookup and single-document summary."""
    return ranked(groups, ["query_id"], ["group_rank"], "select_rank", max_contexts)


def select_compare(groups: DataFrame, max_contexts: int, passes: int = 2) -> DataFrame:
    """Round-robin coverage in closed form: the first `passes` groups of every document round by round, documents in
    order of first appearance, then all others by order."""
    rounds = document_rounds(groups)
    covered = F.col("doc_round") <= passes
    keys = [F.desc(covered), F.when(covered, F.col("doc_round")).otherwise(0), F.when(covered, F.col("doc_first")).otherwise(F.col("group_rank"))]
    return ranked(rounds, ["query_id"], keys, "select_rank", max_contexts)


def select_summary(groups: DataFrame, max_contexts: int) -> DataFrame:
    """One group of each document, then greedy filling with no third group of a document while another one that has groups
    left has fewer than two. In closed form: first groups by order, second groups by order, then all others by order."""
    rounds = document_rounds(groups)
    return ranked(rounds, ["query_id"], [F.least("doc_round", F.lit(3)), "group_rank"], "select_rank", max_contexts).drop("doc_round", "doc_first")


def dropped(groups: DataFrame, selected: DataFrame) -> DataFrame:
    """Groups that were not selected, each once, with the reason."""
    return groups.join(selected.select("query_id", "parent_id"), ["query_id", "parent_id"], "left_anti").withColumn("reason", F.lit("context_budget_exhausted"))


def detail(groups: DataFrame, selected: DataFrame) -> DataFrame:
    """One row a query: selected documents (in order of their first parent) and parents, their numbers, dropped parents.

    groups hold at most a query's candidates; the lists are as long as those.
    """
    rows = groups.select("query_id", "document_id", "parent_id", "group_rank").join(selected.select("query_id", "parent_id", "select_rank"), ["query_id", "parent_id"], "left")
    held = F.sort_array(F.collect_list(F.when(F.col("select_rank").isNotNull(), F.struct("select_rank", "document_id", "parent_id"))))
    lost = F.sort_array(F.collect_list(F.when(F.col("select_rank").isNull(), F.struct("group_rank", "parent_id"))))
    out = rows.groupBy("query_id").agg(held.alias("held"), lost.alias("lost"))
    documents = F.array_distinct(F.transform("held", lambda h: h["document_id"]))
    return out.select(
        "query_id",
        F.size(documents).alias("selected_document_count"),
        F.size("held").alias("selected_parent_count"),
        documents.alias("selected_document_ids"),
        F.transform("held", lambda h: h["parent_id"]).alias("selected_parent_ids"),
        F.transform("lost", lambda h: h["parent_id"]).alias("dropped_by_diversity"),
    )
