"""Benchmark curation: ordered filters, alignment, overrides, votes, report diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest answer and evidence (fixed values).
MAX_ANSWER, MAX_EVIDENCE = 240, 800
#: Words that tie a question to the page's layout (fixed values).
LAYOUT_WORDS = ["figure", "image", "diagram", "bbox", "coordinate", "left side", "right side"]
#: Datasets whose items need evidence, with the reason given (fixed values).
NEEDS_EVIDENCE = {"qasper": "qasper_requires_evidence", "nq": "nq_requires_evidence", "dureader": "dureader_requires_evidence", "drcd": "drcd_requires_evidence"}


def layout_dependent(c: Column) -> Column:
    return F.lower(c).rlike("|".join(LAYOUT_WORDS))


def filter_reason(query: Column, query_type: Column, answer: Column, evidence: Column, dataset: Column) -> Column:
    """The first rule an item breaks, else `kept`; the order of the rules matters."""
    q, a = F.coalesce(F.trim(query), F.lit("")), F.coalesce(F.trim(answer), F.lit(""))
    e = F.filter(F.transform(evidence, lambda x: F.trim(x)), lambda x: x != "")
    none = F.size(e) == 0
    out = (
        F.when(q == "", "missing_query")
        .when(query_type != "fact_lookup", "unsupported_query_type")
        .when(none & (a == ""), "missing_evidence")
        .when(F.length(a) > MAX_ANSWER, "answer_too_long")
        .when(F.exists(e, lambda x: F.length(x) > MAX_EVIDENCE), "evidence_too_long")
        .when(layout_dependent(q) | F.exists(e, layout_dependent), "layout_dependent")
        .when(F.lower(a).rlike(r"\b(yes|no)\b") & (F.length(a) <= 3), "yes_no_answer")
    )
    for name, reason in NEEDS_EVIDENCE.items():
        out = out.when((dataset == name) & none, reason)
    return out.otherwise("kept")


def alignment_status(matches: DataFrame, items: DataFrame) -> DataFrame:
    """items (item_id) with the number of exact spans and auto_matched (one), needs_review (several) or rejected (none)."""
    n = matches.groupBy("item_id").agg(F.count(F.lit(1)).alias("spans"))
    status = F.when(F.col("spans") == 1, "auto_matched").when(F.col("spans") > 1, "needs_review").otherwise("rejected")
    return items.join(n, "item_id", "left").fillna(0, ["spans"]).withColumn("status", status)


def with_overrides(aligned: DataFrame, overrides: DataFrame) -> DataFrame:
    """Alignment with review decisions: approved replaces the spans, rejected clears them, none keeps the automatic ones."""
    j = aligned.join(overrides.select("item_id", "decision", F.col("spans").alias("reviewed")), "item_id", "left")
    spans = F.when(F.col("decision") == "approved", F.col("reviewed")).when(F.col("decision") == "rejected", F.lit(0)).when(F.col("status") == "auto_matched", F.col("spans")).otherwise(0)
    return j.withColumn("final_spans", spans).withColumn("included", F.col("final_spans") > 0)


def vote(answers: DataFrame, key: str, answer: str, place: str) -> DataFrame:
    """The answer most voted for per key: ties to the earliest place, then the shorter answer, then the answer itself."""
    tally = answers.groupBy(key, answer).agg(F.count(F.lit(1)).alias("votes"), F.min(place).alias("first_place"))
    w = Window.partitionBy(key).orderBy(F.desc("votes"), "first_place", F.length(answer), answer)
    return tally.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def report_diff(reference: DataFrame, candidate: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full-outer comparison of two reports: status shared, missing or extra, and a changed flag per column."""
    a, b = reference.withColumn("__a", F.lit(True)), candidate.withColumn("__b", F.lit(True))
    j = a.alias("a").join(b.alias("b"), key, "full_outer")
    status = F.when(F.col("__a") & F.col("__b"), "shared").when(F.col("__a"), "missing").otherwise("extra")
    return j.select(key, status.alias("status"), *[(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"{c}_changed") for c in columns])


def numeric_delta(reference: Column, candidate: Column) -> Column:
    """Candidate minus reference as numbers, strings read as numbers, six decimals; null if either is no number."""
    number = lambda c: c.cast("string").try_cast("double")
    return F.round(number(candidate) - number(reference), 6)
