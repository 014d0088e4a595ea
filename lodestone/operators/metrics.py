"""Ranking metrics over (query, stage) groups of ranked candidates, and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["ndcg", "recall", "mrr", "precision", "doc_coverage"]


def overlaps(a: str, b: str) -> Column:
    """Half-open spans of two aliased tables share a character; touching is not enough."""
    return (F.col(f"{a}.start_offset") < F.col(f"{b}.end_offset")) & (F.col(f"{b}.start_offset") < F.col(f"{a}.end_offset"))


def relevance(candidates: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """candidates with `relevance`: the highest grade of a gold span of the query that overlaps the candidate, else 0.

    The join is an equi-join on query and document with the overlap as residual condition.
    """
    on = (F.col("c.query_id") == F.col("g.query_id")) & (F.col("c.document_id") == F.col("g.document_id")) & overlaps("c", "g")
    hits = candidates.alias("c").join(gold.alias("g"), on).groupBy(*[F.col(f"c.{k}").alias(k) for k in keys]).agg(F.max("g.grade").alias("relevance"))
    return candidates.join(hits, keys, "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def _gain(rel: Column) -> Column:
    return F.pow(F.lit(2.0), rel) - 1


def stage_metrics(ranked: DataFrame, gold: DataFrame, k: int, by: list[str], rank: str = "rank") -> DataFrame:
    """One row per group: nDCG, hit rate, MRR, precision and document coverage at k, first hit rank.

    nDCG's ideal is the retrieved list in its best order; `recall` is whether anything was hit; precision divides by k.
    """
    top = ranked.where(F.col(rank) <= k)
    ideal = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("relevance"), rank))
    top = top.withColumn("ideal", ideal).join(gold.select("query_id", F.col("document_id"), F.lit(1).alias("is_gold")).distinct(), ["query_id", "document_id"], "left")
    first = F.min(F.when(F.col("relevance") > 0, F.col(rank)))
    best = F.sum(_gain(F.col("relevance")) / F.log2(F.col("ideal") + 1))
    out = top.groupBy(*by).agg(
        F.when(best > 0, F.sum(_gain(F.col("relevance")) / F.log2(F.col(rank) + 1)) / best).otherwise(0.0).alias("ndcg"),
        F.max((F.col("relevance") > 0).cast("int")).cast("double").alias("recall"),
        F.coalesce(1 / first, F.lit(0.0)).alias("mrr"),
        (F.sum((F.col("relevance") > 0).cast("int")) / k).alias("precision"),
        F.countDistinct(F.when(F.col("is_gold") == 1, F.col("document_id"))).alias("gold_seen"),
        first.alias("first_hit_rank"),
        F.nullif(F.max("relevance"), F.lit(0)).alias("max_relevance"),
    )
    wanted = gold.groupBy("query_id").agg(F.countDistinct("document_id").alias("gold_documents"))
    out = out.join(wanted, "query_id", "left")
    return out.withColumn("doc_coverage", F.when(F.col("gold_documents") > 0, F.col("gold_seen") / F.col("gold_documents")).otherwise(0.0)).drop("gold_seen", "gold_documents")


def averages(metrics: DataFrame, dimensions: list[str]) -> DataFrame:
    """Means per stage, and per stage and each dimension, by one pass of grouping sets."""
    sets = [("stage",), *(("stage", d) for d in dimensions)]
    keys = ["stage", *dimensions]
    return metrics.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys]).agg(*[F.avg(m).alias(m) for m in METRICS], F.count(F.lit(1)).alias("n"))
