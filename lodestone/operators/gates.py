"""Summary/compare evaluation: averages, gates, failure categories, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS

#: Gates: metric, threshold, comparator (fixed values; three come from the settings).
GATES = [
    ("task_type_accuracy", 1.0, ">="),
    ("summary_strategy_accuracy", 0.875, ">="),
    ("required_document_coverage", 0.9, ">="),
    ("citation_coverage", 0.9, ">="),
    ("section_coverage", 0.8, ">="),
    ("fallback_rate", 0.1, "<="),
    ("avg_faithfulness_to_citations", 4.5, ">="),
    ("avg_overall_score", DEFAULTS.eval_min_avg_score, ">="),
    ("min_per_item_overall_score", 3.0, ">="),
    ("p95_latency_seconds", DEFAULTS.eval_max_p95_seconds, "<="),
    ("timeout_count", 0.0, "=="),
    ("hard_blocker_failures", 0.0, "=="),
]
#: Judge scores below which an item counts in a failure category (fixed values).
LOW_SCORES = {"judge_low_faithfulness": ("faithfulness", 4.5), "judge_low_completeness": ("completeness", 4.0), "judge_low_structure_quality": ("structure_quality", 4.0), "judge_low_coverage": ("compare_coverage", 4.0)}


def percentile(c: Column, p: float) -> Column:
    """Nearest-rank percentile of a group."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c._jc.toString()})")


def aggregate(items: DataFrame) -> DataFrame:
    """One row of means over items, four decimals, with the 95th percentile of the latency and the timeouts."""
    share = lambda c, name: F.round(F.avg(F.col(c).cast("double")), 4).alias(name)
    return items.agg(
        share("task_type_matched", "task_type_accuracy"),
        share("summary_strategy_matched", "summary_strategy_accuracy"),
        share("required_document_coverage", "required_document_coverage"),
        share("citation_coverage", "citation_coverage"),
        share("section_coverage", "section_coverage"),
        share("fallback_triggered", "fallback_rate"),
        share("faithfulness", "avg_faithfulness_to_citations"),
        share("overall", "avg_overall_score"),
        F.round(F.min("overall"), 4).alias("min_per_item_overall_score"),
        F.round(percentile(F.col("latency_seconds"), 0.95), 4).alias("p95_latency_seconds"),
        F.sum(F.array_contains("blockers", "timeout").cast("int")).cast("double").alias("timeout_count"),
        F.sum(F.size("blockers")).cast("double").alias("hard_blocker_failures"),
    )


def gates(metrics: DataFrame) -> DataFrame:
    """One row per gate: name, actual, threshold, comparator, passed."""
    rows = metrics.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("actual"), F.lit(float(t)).alias("threshold"), F.lit(c).alias("comparator")) for n, t, c in GATES])).alias("g")).select("g.*")
    a, t, c = F.col("actual"), F.col("threshold"), F.col("comparator")
    return rows.withColumn("passed", F.when(c == ">=", a >= t).when(c == "<=", a <= t).otherwise(a == t))


def failure_categories(items: DataFrame) -> DataFrame:
    """How often each blocker and each low judge score occurs."""
    low = F.filter(F.array(*[F.when(F.col(c) < t, name) for name, (c, t) in LOW_SCORES.items()]), lambda x: x.isNotNull())
    return items.select(F.explode(F.concat("blockers", low)).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def scored_mean(value: str, status: str) -> list[Column]:
    """(value, status) of a group of metric results: the mean of scored values; else judge_failed if any; else not_applicable."""
    scored = F.count(F.when(F.col(status) == "scored", 1))
    mean = F.round(F.avg(F.when(F.col(status) == "scored", F.col(value))), 6).alias(value)
    failed = F.max((F.col(status) == "judge_failed").cast("int")) == 1
    return [mean, F.when(scored > 0, "scored").when(failed, "judge_failed").otherwise("not_applicable").alias(status)]


def coverage(expected: Column, found: Column) -> Column:
    """Share of expected names among those found, four decimals; the divisor is at least one."""
    return F.round(F.size(F.array_intersect(expected, found)) / F.greatest(F.size(F.array_distinct(expected)), F.lit(1)), 4)


def latency_status(seconds: Column, target: float = DEFAULTS.latency_target_seconds, most: float = DEFAULTS.latency_max_seconds) -> Column:
    """ok, degraded above the target, warning (the worse level) above the most."""
    return F.when(seconds > most, "warning").when(seconds > target, "degraded").otherwise("ok")
