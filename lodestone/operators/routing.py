"""Query routing: trigger rules, label decisions, scopes, profiles."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text

# Trigger phrases (fixed values).
SUMMARY_HAN, SUMMARY_LATIN = ["摘要", "總結", "整理", "概述", "重點"], ["summary", "summarize", "overview", "key points"]
COMPARE_HAN, COMPARE_LATIN = ["比較", "差異", "相比", "不同", "優缺點"], ["compare", "comparison", "difference", "vs", "versus"]
SECTION_HAN, SECTION_LATIN = ["章節", "段落", "部分", "聚焦", "著重"], ["section", "chapter", "part", "focus on"]
#: Confidence by the number of phrases hit, and what the embedding classifier must reach (fixed values).
ONE_HIT, MORE_HITS, MIN_CONFIDENCE, MIN_MARGIN = 0.84, 0.92, 0.78, 0.05
#: The same for the summary strategy, and the confidence of its scope rule (fixed values).
STRATEGY_CONFIDENCE, STRATEGY_MARGIN, SCOPE_RULE = 0.8, 0.06, 0.9
OVERVIEW, SECTION, THEME = "document_overview", "section_focused", "multi_document_theme"


def rule_confidence(hits: Column) -> Column:
    n = F.size(hits)
    return F.when(n >= 2, MORE_HITS).when(n == 1, ONE_HIT).otherwise(0.0)


def task_type(query: Column) -> Column:
    """struct(label, confidence, hits) of the rules; compare beats summary; null label without a hit."""
    compare, summary = text.phrase_hits(query, COMPARE_HAN, COMPARE_LATIN), text.phrase_hits(query, SUMMARY_HAN, SUMMARY_LATIN)
    label = F.when(F.size(compare) > 0, "cross_document_compare").when(F.size(summary) > 0, "document_summary")
    hits = F.when(F.size(compare) > 0, compare).otherwise(summary)
    return F.struct(label.alias("label"), rule_confidence(hits).alias("confidence"), hits.alias("hits"))


def decide(explicit: Column, rule: Column, embedded: Column, confidence: Column, margin: Column, fallback: str) -> Column:
    """struct(label, source): explicit, then rule, then a confident embedding, then the safe fallback."""
    sure = (confidence >= MIN_CONFIDENCE) & (margin >= MIN_MARGIN)
    label = F.coalesce(explicit, rule, F.when(sure, embedded), F.lit(fallback))
    source = F.when(explicit.isNotNull(), "explicit").when(rule.isNotNull(), "rule").when(sure, "embedding").otherwise("fallback")
    return F.struct(label.alias("label"), source.alias("source"))


def summary_strategy(query: Column, query_type: Column, resolved: Column, scope: Column, explicit: Column, embedded: Column, confidence: Column, margin: Column) -> Column:
    """struct(label, source, confidence, reason) of a summary's strategy.

    Explicit, then rules (several documents or a multi-document scope: theme; one document and a section phrase: section),
    then a confident embedding label that does not conflict with the documents named, then the safe fallback. `resolved` is
    how many documents the query names. Other query types have no strategy.
    """
    several = (resolved >= 2) | F.coalesce(scope == "multi_document", F.lit(False))
    hits = text.phrase_hits(query, SECTION_HAN, SECTION_LATIN)
    rule = F.when(several, THEME).when((resolved == 1) & (F.size(hits) > 0), SECTION)
    rule_score = F.when(several, SCOPE_RULE).otherwise(rule_confidence(hits))
    conflict = F.when((resolved >= 2) & (embedded != THEME), "multi_document_scope_conflict").when((resolved == 1) & (embedded == THEME), "single_document_scope_conflict")
    sure = (confidence >= STRATEGY_CONFIDENCE) & (margin >= STRATEGY_MARGIN) & conflict.isNull()
    safe = F.when((scope == "single_document") & (resolved == 1), OVERVIEW).otherwise(THEME)
    made = lambda label, source, score, reason=None: F.struct(label.alias("label"), F.lit(source).alias("source"), score.cast("double").alias("confidence"), F.lit(reason).cast("string").alias("reason"))
    return (
        F.when(query_type != "document_summary", made(F.lit(""), "not_applicable", F.lit(0.0)))
        .when(explicit.isNotNull(), made(explicit, "explicit", F.lit(1.0)))
        .when(rule.isNotNull(), made(rule, "rule", rule_score))
        .when(sure, made(embedded, "embedding", confidence))
        .otherwise(made(safe, "fallback", F.lit(0.0), "llm_fallback_unavailable"))
    )


def summary_scope(query_type: Column, resolved: Column, scope: Column, strategy: Column) -> Column:
    """single_document or multi_document for summaries, null for other queries."""
    single = (strategy != THEME) & (scope == "single_document") & (resolved == 1)
    return F.when(query_type == "document_summary", F.when(single, "single_document").otherwise("multi_document"))


def document_scope(resolved: Column, hint: Column) -> Column:
    n = F.size(resolved)
    return F.when(n == 1, "single_document").when(n >= 2, "multi_document").otherwise(F.coalesce(hint, F.lit("area")))


def profiles(spark: SparkSession, s: Settings = DEFAULTS) -> DataFrame:
    """The runtime profile of each kind of question: settings raised to the profile's floors."""
    up = lambda a, b: max(a, b)
    summary = (up(s.vector_top_k, 45), up(s.fts_top_k, 45), up(s.max_candidates, 45), up(s.rerank_top_n, 36), up(s.assembler_max_contexts, 12), up(s.assembler_max_chars, 3600), up(s.assembler_max_children, 7))
    compare = (*summary[:5], up(s.assembler_max_chars, 3200), up(s.assembler_max_children, 5))
    fact = (s.vector_top_k, s.fts_top_k, s.max_candidates, s.rerank_top_n, s.assembler_max_contexts, s.assembler_max_chars, s.assembler_max_children)
    rows = [
        ("fact_lookup", None, False, s.document_recall_top_k, *fact),
        ("document_summary", "single_document", True, 1, *summary),
        ("document_summary", "multi_document", True, up(s.document_recall_top_k, 6), *summary),
        ("cross_document_compare", None, True, up(s.document_recall_top_k, 8), *compare),
    ]
    return spark.createDataFrame(rows, "query_type string, summary_scope string, document_recall boolean, document_recall_top_k int, vector_top_k int, fts_top_k int, max_candidates int, rerank_top_n int, max_contexts int, max_chars int, max_children int")


#: Deepest rerank of the guarded profiles (fixed value).
GUARDED_DEPTH = 100


def _gate(s: Settings) -> Settings:
    return replace(s, rerank_top_n=min(s.rerank_top_n, 4), vector_top_k=min(s.vector_top_k, 6), fts_top_k=min(s.fts_top_k, 6), max_candidates=min(s.max_candidates, 8), assembler_max_contexts=min(s.assembler_max_contexts, 4), assembler_max_children=min(s.assembler_max_children, 2))


def _guarded(s: Settings, rerank: int, contexts: int, chars: int, children: int) -> Settings:
    depth = min(max(s.rerank_top_n, rerank), GUARDED_DEPTH)
    return replace(s, rerank_top_n=depth, assembler_max_contexts=max(s.assembler_max_contexts, contexts), assembler_max_chars=max(s.assembler_max_chars, chars), assembler_max_children=max(s.assembler_max_children, children))


def evaluation_settings(profile: str, s: Settings = DEFAULTS) -> tuple[Settings, bool]:
    """(settings, whether reranking is deterministic) of an evaluation profile; gates inherit from their base."""
    base = profile.removesuffix("_gate")
    if base == "generic_guarded_assembler_v1":
        return _guarded(s, 8, 8, 3200, 4), profile != base
    if base == "generic_guarded_assembler_v2":
        return _guarded(s, 10, 10, 3600, 5), profile != base
    if profile == "deterministic_gate_v1":
        return _gate(s), True
    if profile == "production_like_v1":
        return s, False
    raise ValueError(f"unknown evaluation profile {profile}")


def settings_trace(decisions: DataFrame, profile_rows: DataFrame) -> DataFrame:
    """decisions (query_type, summary_scope, margin, fallback_used beside the question's own columns) with the settings
    that its profile has for it. Profiles are a handful of rows and are broadcast."""
    p = profile_rows.alias("p")
    match = (F.col("d.query_type") == F.col("p.query_type")) & (F.col("p.summary_scope").isNull() | F.col("d.summary_scope").eqNullSafe(F.col("p.summary_scope")))
    names = ["vector_top_k", "fts_top_k", "max_candidates", "document_recall", "document_recall_top_k", "rerank_top_n", "max_contexts", "max_chars", "max_children"]
    return decisions.alias("d").join(F.broadcast(p), match, "left").select("d.*", *[F.col(f"p.{n}").alias(n) for n in names], F.col("p.max_contexts").alias("selection_max_contexts"))
