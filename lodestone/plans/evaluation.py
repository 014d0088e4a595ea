"""Queries over access, curation, gates, routing and keyed writes."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import curation, fallback, gates, mentions, recall, routing
from ..operators import documents as ops
from ..sources import adapters
from .catalog import register

_T = adapters.table

_ROLES = """
user_roles AS (SELECT 'src' || (c_custkey % 20) AS area_id, c_custkey AS principal, CASE c_custkey % 4 WHEN 0 THEN 'reader' WHEN 1 THEN 'maintainer' WHEN 2 THEN 'admin' END AS role FROM customer WHERE c_custkey % 4 < 3),
group_roles AS (SELECT 'src' || (n_nationkey % 20) AS area_id, n_nationkey AS group_path, CASE n_nationkey % 3 WHEN 0 THEN 'reader' ELSE 'maintainer' END AS role FROM nation WHERE n_nationkey % 5 < 3),
role_rows AS (SELECT principal, area_id, role FROM user_roles UNION ALL SELECT c_custkey, g.area_id, g.role FROM customer JOIN group_roles g ON g.group_path = c_nationkey),
effective AS (SELECT principal, area_id, CASE max(CASE role WHEN 'reader' THEN 1 WHEN 'maintainer' THEN 2 ELSE 3 END) WHEN 1 THEN 'reader' WHEN 2 THEN 'maintainer' ELSE 'admin' END AS role FROM role_rows GROUP BY ALL)
"""


def _effective(spark: SparkSession, sf: str) -> DataFrame:
    c, n = _T(spark, sf, "customer"), _T(spark, sf, "nation")
    principals = c.select(F.col("c_custkey").alias("principal"), F.col("c_nationkey").alias("group_path"))
    area = lambda k: F.concat(F.lit("src"), F.col(k) % 20)
    users = c.where("c_custkey % 4 < 3").select(area("c_custkey").alias("area_id"), F.col("c_custkey").alias("principal"), F.element_at(F.array(F.lit("reader"), F.lit("maintainer"), F.lit("admin")), (F.col("c_custkey") % 4 + 1).cast("int")).alias("role"))
    groups = n.where("n_nationkey % 5 < 3").select(area("n_nationkey").alias("area_id"), F.col("n_nationkey").alias("group_path"), F.when(F.col("n_nationkey") % 3 == 0, "reader").otherwise("maintainer").alias("role"))
    return ops.effective_roles(principals, users, groups)


@register("effective_roles", f"WITH {_ROLES.strip()} SELECT * FROM effective")
def effective_roles(spark: SparkSession, sf: str) -> DataFrame:
    return _effective(spark, sf)


@register("access_outcome", f"WITH {_ROLES.strip()}, requests AS (SELECT c_custkey AS principal, 'src' || (c_custkey % 7) AS area_id FROM customer) SELECT r.principal, r.area_id, CASE WHEN e.role IS NULL THEN 'not_found' WHEN e.role = 'reader' THEN 'forbidden' ELSE 'allow' END AS outcome FROM requests r LEFT JOIN effective e USING (principal, area_id)")
def access_outcome(spark: SparkSession, sf: str) -> DataFrame:
    requests = _T(spark, sf, "customer").select(F.col("c_custkey").alias("principal"), F.concat(F.lit("src"), F.col("c_custkey") % 7).alias("area_id"))
    return ops.access_outcome(requests, _effective(spark, sf), "maintainer").select("principal", "area_id", "outcome")


@register("accessible_areas", f"WITH {_ROLES.strip()} SELECT principal, count(*) AS areas, max(area_id) AS last_area, count(*) FILTER (role = 'admin') AS admin_areas FROM effective GROUP BY ALL")
def accessible_areas(spark: SparkSession, sf: str) -> DataFrame:
    return _effective(spark, sf).groupBy("principal").agg(F.count(F.lit(1)).alias("areas"), F.max("area_id").alias("last_area"), F.count(F.when(F.col("role") == "admin", 1)).alias("admin_areas"))


@register("visible_chunks", adapters.sql("SELECT e.principal, sum(n)::BIGINT AS chunks FROM effective e JOIN (SELECT area_id, count(*) AS n FROM children WHERE status = 'ready' GROUP BY ALL) USING (area_id) GROUP BY ALL", _ROLES))
def visible_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Ready chunks that each principal may read; deny by default."""
    per_area = recall.gate(adapters.children(adapters.documents(spark, sf))).groupBy("area_id").agg(F.count(F.lit(1)).alias("n"))
    return _effective(spark, sf).join(per_area, "area_id").groupBy("principal").agg(F.sum("n").alias("chunks"))


@register("duplicate_keys", "SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 5")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return ops.duplicates(_T(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag"]).where("n > 5")


@register("keyed_upsert", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 9 ELSE quality END::INT AS quality FROM labels UNION ALL SELECT doc_id, 9 FROM documents WHERE doc_id % 5 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def keyed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    changes = _T(spark, sf, "documents").where("doc_id % 5 = 0").select("doc_id", F.lit(9).cast("int").alias("quality"))
    return ops.upsert(_T(spark, sf, "labels").select("doc_id", "quality"), changes, ["doc_id"])


@register("append_absent", "SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def append_absent(spark: SparkSession, sf: str) -> DataFrame:
    rows = _T(spark, sf, "documents").select("doc_id", F.lit(0).cast("int").alias("quality"))
    return ops.append_absent(_T(spark, sf, "labels").select("doc_id", "quality"), rows, ["doc_id"])


@register("last_entry_wins", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def last_entry_wins(spark: SparkSession, sf: str) -> DataFrame:
    return ops.last_wins(_T(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@register("delete_cascade", adapters.sql("SELECT 'documents' AS name, count(*) AS n FROM docs WHERE document_id % 3 <> 0 UNION ALL SELECT 'children', count(*) FROM children WHERE document_id % 3 <> 0"))
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapters.documents(spark, sf)
    left = ops.delete_cascade({"documents": docs, "children": adapters.children(docs)}, "document_id", docs.where("document_id % 3 = 0"))
    counts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in left.items()]
    return counts[0].union(counts[1])


@register("chat_sessions", "SELECT conv_id, CASE WHEN trim(arg_min(text, turn)) = '' THEN 'New chat' ELSE substr(trim(arg_min(text, turn)), 1, 40) END AS title, count(*) AS turns, count(*) FILTER (role = 'assistant') AS assistant_turns FROM conversations GROUP BY ALL")
def chat_sessions(spark: SparkSession, sf: str) -> DataFrame:
    c = _T(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"), F.count(F.lit(1)).alias("turns"), F.count(F.when(F.col("role") == "assistant", 1)).alias("assistant_turns"))
    return c.select("conv_id", F.coalesce(F.substring(text.optional(F.col("t")), 1, 40), F.lit("New chat")).alias("title"), "turns", "assistant_turns")


@register("thread_state", "SELECT conv_id, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS messages FROM conversations GROUP BY ALL")
def thread_state(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of a thread appended in order."""
    item = F.struct("turn", F.concat("role", F.lit(":"), "text").alias("m"))
    c = _T(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("l"))
    return c.select("conv_id", F.md5(F.array_join(F.transform("l", lambda s: s["m"]), "\n")).alias("messages"))


_ITEMS = """
items AS (SELECT conv_id * 1000 + turn AS item_id, CASE WHEN conv_id % 11 = 0 THEN '' ELSE text END AS query_text, CASE WHEN conv_id % 7 = 0 THEN 'document_summary' ELSE 'fact_lookup' END AS query_type,
  CASE conv_id % 5 WHEN 0 THEN 'no' WHEN 1 THEN repeat(text, 4) WHEN 2 THEN '' ELSE substr(text, 1, 30) END AS answer_text,
  CASE WHEN turn % 3 = 0 THEN [] WHEN turn % 5 = 0 THEN ['see figure 2'] WHEN conv_id % 13 = 0 THEN [repeat(text, 30)] ELSE [' ', text] END AS evidence,
  CASE conv_id % 4 WHEN 0 THEN 'qasper' WHEN 1 THEN 'nq' WHEN 2 THEN 'drcd' ELSE 'uda' END AS dataset FROM conversations)
"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return _T(spark, sf, "conversations").selectExpr(
        "conv_id * 1000 + turn AS item_id",
        "CASE WHEN conv_id % 11 = 0 THEN '' ELSE text END AS query_text",
        "CASE WHEN conv_id % 7 = 0 THEN 'document_summary' ELSE 'fact_lookup' END AS query_type",
        "CASE conv_id % 5 WHEN 0 THEN 'no' WHEN 1 THEN repeat(text, 4) WHEN 2 THEN '' ELSE substr(text, 1, 30) END AS answer_text",
        "CASE WHEN turn % 3 = 0 THEN array() WHEN turn % 5 = 0 THEN array('see figure 2') WHEN conv_id % 13 = 0 THEN array(repeat(text, 30)) ELSE array(' ', text) END AS evidence",
        "CASE conv_id % 4 WHEN 0 THEN 'qasper' WHEN 1 THEN 'nq' WHEN 2 THEN 'drcd' ELSE 'uda' END AS dataset",
    )


_REASON = """
CASE WHEN trim(query_text) = '' THEN 'missing_query' WHEN query_type <> 'fact_lookup' THEN 'unsupported_query_type' WHEN len(e) = 0 AND trim(answer_text) = '' THEN 'missing_evidence'
  WHEN length(trim(answer_text)) > 240 THEN 'answer_too_long' WHEN len(list_filter(e, lambda x: length(x) > 800)) > 0 THEN 'evidence_too_long'
  WHEN regexp_matches(lower(query_text), 'figure|image|diagram|bbox|coordinate|left side|right side') OR len(list_filter(e, lambda x: regexp_matches(lower(x), 'figure|image|diagram|bbox|coordinate|left side|right side'))) > 0 THEN 'layout_dependent'
  WHEN regexp_matches(lower(answer_text), '\\b(yes|no)\\b') AND length(trim(answer_text)) <= 3 THEN 'yes_no_answer'
  WHEN dataset = 'qasper' AND len(e) = 0 THEN 'qasper_requires_evidence' WHEN dataset = 'nq' AND len(e) = 0 THEN 'nq_requires_evidence' WHEN dataset = 'drcd' AND len(e) = 0 THEN 'drcd_requires_evidence' ELSE 'kept' END
"""


@register("curation_filter", f"WITH {_ITEMS.strip()} SELECT reason, count(*) AS n FROM (SELECT {_REASON.strip()} AS reason FROM (SELECT *, list_filter(list_transform(evidence, lambda x: trim(x)), lambda x: x <> '') AS e FROM items)) GROUP BY ALL")
def curation_filter(spark: SparkSession, sf: str) -> DataFrame:
    reason = curation.filter_reason(*[F.col(c) for c in ("query_text", "query_type", "answer_text", "evidence", "dataset")])
    return _items(spark, sf).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_ALIGN = "SELECT b.item_id, count(d.document_id) AS spans, CASE count(d.document_id) WHEN 1 THEN 'auto_matched' WHEN 0 THEN 'rejected' ELSE 'needs_review' END AS status FROM benchmark b LEFT JOIN docs d ON contains(d.display_text, b.text) AND d.status = 'ready' GROUP BY ALL"


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    spans = adapters.gold_spans(adapters.documents(spark, sf), spark, sf).select(F.col("query_id").alias("item_id"))
    return curation.alignment_status(spans, _T(spark, sf, "benchmark").select("item_id"))


@register("alignment_status", adapters.sql(_ALIGN))
def alignment_status(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(spark, sf)


@register("snapshot_overrides", adapters.sql("SELECT a.item_id, a.status, CASE WHEN a.item_id % 9 = 0 THEN 2 WHEN a.item_id % 9 = 1 THEN 0 WHEN a.status = 'auto_matched' THEN a.spans ELSE 0 END::BIGINT AS final_spans, (CASE WHEN a.item_id % 9 = 0 THEN 2 WHEN a.item_id % 9 = 1 THEN 0 WHEN a.status = 'auto_matched' THEN a.spans ELSE 0 END) > 0 AS included FROM aligned a", f"aligned AS ({_ALIGN})"))
def snapshot_overrides(spark: SparkSession, sf: str) -> DataFrame:
    decision = F.when(F.col("item_id") % 9 == 0, "approved").otherwise("rejected")
    reviews = _T(spark, sf, "benchmark").where("item_id % 9 < 2").select("item_id", decision.alias("decision"), F.lit(2).alias("spans"))
    return curation.with_overrides(_aligned(spark, sf), reviews).select("item_id", "status", "final_spans", "included")


@register("majority_vote", "SELECT user_id, event_type, votes, first_place FROM (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS first_place FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first_place, length(event_type), event_type) = 1")
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return curation.vote(_T(spark, sf, "events"), "user_id", "event_type", "event_id").select("user_id", "event_type", "votes", "first_place")


_REPORTS = "a AS (SELECT doc_id, quality AS hit, nullif(doc_id % 7, 0) AS rank FROM labels WHERE doc_id % 4 <> 0), b AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 0 ELSE quality END AS hit, nullif(doc_id % 7, 3) AS rank FROM labels WHERE doc_id % 5 <> 0)"


@register("report_diff", f"WITH {_REPORTS} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'extra' WHEN b.doc_id IS NULL THEN 'missing' ELSE 'shared' END AS status, a.hit IS DISTINCT FROM b.hit AS hit_changed, a.rank IS DISTINCT FROM b.rank AS rank_changed FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def report_diff(spark: SparkSession, sf: str) -> DataFrame:
    labels = _T(spark, sf, "labels")
    a = labels.where("doc_id % 4 <> 0").select("doc_id", F.col("quality").alias("hit"), F.nullif(F.col("doc_id") % 7, F.lit(0)).alias("rank"))
    b = labels.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality")).alias("hit"), F.nullif(F.col("doc_id") % 7, F.lit(3)).alias("rank"))
    return curation.report_diff(a, b, "doc_id", ["hit", "rank"])


@register("metric_deltas", "SELECT event_type, round(try_cast(json_extract_string(max(props), '$.k') AS DOUBLE) - round(avg(value), 3), 6) AS delta, round(max(value) - min(value), 6) AS spread FROM events GROUP BY ALL")
def metric_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers read from JSON text minus averages; what is no number gives null."""
    e = _T(spark, sf, "events").groupBy("event_type").agg(F.max("props").alias("p"), F.round(F.avg("value"), 3).alias("m"), F.round(F.max("value") - F.min("value"), 6).alias("spread"))
    return e.select("event_type", curation.numeric_delta(F.col("m"), F.get_json_object("p", "$.k")).alias("delta"), "spread")


_JUDGED = """
judged AS (SELECT l.doc_id, d.lang, CASE WHEN d.doc_id % 2 = 0 THEN 'summary' ELSE 'compare' END AS family, d.source AS dataset, quality = 1 AS task_type_matched, l.doc_id % 6 <> 0 AS summary_strategy_matched,
  (l.doc_id % 5) / 4.0::DOUBLE AS required_document_coverage, (l.doc_id % 4) / 3.0::DOUBLE AS citation_coverage, (l.doc_id % 3) / 2.0::DOUBLE AS section_coverage, toxic = 1 AS fallback_triggered,
  (3 + quality + (l.doc_id % 2) / 2.0)::DOUBLE AS faithfulness, (3.5 + quality * 0.5 + (l.doc_id % 3) / 4.0)::DOUBLE AS completeness, (3 + l.doc_id % 3)::DOUBLE AS structure_quality, (3 + l.doc_id % 2)::DOUBLE AS compare_coverage,
  (2 + quality * 2 + (l.doc_id % 5) / 5.0)::DOUBLE AS overall, (d.n_chars / 100.0)::DOUBLE AS latency_seconds,
  list_filter([CASE WHEN toxic = 1 THEN 'timeout' END, CASE WHEN quality = 0 THEN 'task_type_mismatch' END, CASE WHEN l.doc_id % 10 = 0 THEN 'required_document_not_cited' END], lambda x: x IS NOT NULL) AS blockers,
  CASE WHEN l.doc_id % 8 = 0 THEN 'judge_failed' WHEN l.doc_id % 9 = 0 THEN 'not_applicable' ELSE 'scored' END AS status
  FROM labels l JOIN documents d USING (doc_id))
"""


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    j = _T(spark, sf, "labels").join(_T(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    return j.selectExpr(
        "doc_id", "lang", "CASE WHEN doc_id % 2 = 0 THEN 'summary' ELSE 'compare' END AS family", "source AS dataset", "quality = 1 AS task_type_matched", "doc_id % 6 <> 0 AS summary_strategy_matched",
        "(doc_id % 5) / 4D AS required_document_coverage", "(doc_id % 4) / 3D AS citation_coverage", "(doc_id % 3) / 2D AS section_coverage", "toxic = 1 AS fallback_triggered",
        "3 + quality + (doc_id % 2) / 2D AS faithfulness", "3.5D + quality * 0.5D + (doc_id % 3) / 4D AS completeness", "CAST(3 + doc_id % 3 AS DOUBLE) AS structure_quality", "CAST(3 + doc_id % 2 AS DOUBLE) AS compare_coverage",
        "2 + quality * 2 + (doc_id % 5) / 5D AS overall", "n_chars / 100D AS latency_seconds",
        "filter(array(CASE WHEN toxic = 1 THEN 'timeout' END, CASE WHEN quality = 0 THEN 'task_type_mismatch' END, CASE WHEN doc_id % 10 = 0 THEN 'required_document_not_cited' END), x -> x IS NOT NULL) AS blockers",
        "CASE WHEN doc_id % 8 = 0 THEN 'judge_failed' WHEN doc_id % 9 = 0 THEN 'not_applicable' ELSE 'scored' END AS status",
    )


_GATE_ROWS = " UNION ALL ".join(f"SELECT '{n}' AS name, {n}::DOUBLE AS actual, {t}::DOUBLE AS threshold, '{c}' AS comparator, {n} {'=' if c == '==' else c} {t} AS passed FROM agg" for n, t, c in gates.GATES)
_AGG = """
agg AS (SELECT round(avg(task_type_matched::INT), 4) AS task_type_accuracy, round(avg(summary_strategy_matched::INT), 4) AS summary_strategy_accuracy, round(avg(required_document_coverage), 4) AS required_document_coverage,
  round(avg(citation_coverage), 4) AS citation_coverage, round(avg(section_coverage), 4) AS section_coverage, round(avg(fallback_triggered::INT), 4) AS fallback_rate, round(avg(faithfulness), 4) AS avg_faithfulness_to_citations,
  round(avg(overall), 4) AS avg_overall_score, round(min(overall), 4) AS min_per_item_overall_score, round(quantile_disc(latency_seconds, 0.95), 4) AS p95_latency_seconds,
  sum(list_contains(blockers, 'timeout')::INT) AS timeout_count, sum(len(blockers)) AS hard_blocker_failures FROM judged)
"""


@register("gate_results", f"WITH {_JUDGED.strip()}, {_AGG.strip()} {_GATE_ROWS}")
def gate_results(spark: SparkSession, sf: str) -> DataFrame:
    return gates.gates(gates.aggregate(_judged(spark, sf)))


@register("failure_categories", f"WITH {_JUDGED.strip()} SELECT category, count(*) AS n FROM (SELECT unnest(list_concat(blockers, list_filter([CASE WHEN faithfulness < 4.5 THEN 'judge_low_faithfulness' END, CASE WHEN completeness < 4 THEN 'judge_low_completeness' END, CASE WHEN structure_quality < 4 THEN 'judge_low_structure_quality' END, CASE WHEN compare_coverage < 4 THEN 'judge_low_coverage' END], lambda x: x IS NOT NULL))) AS category FROM judged) GROUP BY ALL")
def failure_categories(spark: SparkSession, sf: str) -> DataFrame:
    return gates.failure_categories(_judged(spark, sf))


_DATASET = "dataset_scores AS (SELECT dataset, family, lang, round(avg(CASE WHEN status = 'scored' THEN overall END), 6) AS overall, CASE WHEN count(*) FILTER (status = 'scored') > 0 THEN 'scored' WHEN bool_or(status = 'judge_failed') THEN 'judge_failed' ELSE 'not_applicable' END AS status FROM judged GROUP BY ALL)"


@register("dataset_scores", f"WITH {_JUDGED.strip()}, {_DATASET} SELECT * FROM dataset_scores")
def dataset_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).groupBy("dataset", "family", "lang").agg(*gates.scored_mean("overall", "status"))


@register("score_rollups", f"WITH {_JUDGED.strip()}, {_DATASET} SELECT family, lang, round(avg(CASE WHEN status = 'scored' THEN overall END), 5) AS overall, count(*) AS datasets FROM dataset_scores GROUP BY GROUPING SETS ((family), (family, lang))")
def score_rollups(spark: SparkSession, sf: str) -> DataFrame:
    """Second-level means of dataset scores by family, and by language and family."""
    d = dataset_scores(spark, sf)
    sets = [[F.col("family")], [F.col("family"), F.col("lang")]]
    return d.groupingSets(sets, F.col("family"), F.col("lang")).agg(F.round(F.avg(F.when(F.col("status") == "scored", F.col("overall"))), 5).alias("overall"), F.count(F.lit(1)).alias("datasets"))


@register("baseline_compare", f"WITH {_JUDGED.strip()}, {_DATASET} SELECT c.dataset, c.family, c.lang, round(c.overall - coalesce(b.overall, 0), 6) AS delta FROM dataset_scores c LEFT JOIN dataset_scores b ON b.dataset = c.dataset AND b.family = 'summary' AND b.lang = c.lang WHERE c.status = 'scored'")
def baseline_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Scores minus the baseline's, zero where the baseline has none."""
    d = dataset_scores(spark, sf)
    b = d.where("family = 'summary'").select("dataset", "lang", F.col("overall").alias("base"))
    return d.where("status = 'scored'").join(b, ["dataset", "lang"], "left").select("dataset", "family", "lang", F.round(F.col("overall") - F.coalesce("base", F.lit(0.0)), 6).alias("delta"))


@register("latency_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) FILTER (value > 40) AS warning, count(*) FILTER (value > 20 AND value <= 40) AS degraded FROM events GROUP BY ALL")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    e = _T(spark, sf, "events").withColumn("status", gates.latency_status(F.col("value")))
    return e.groupBy("event_type").agg(gates.percentile(F.col("value"), 0.5).alias("p50"), gates.percentile(F.col("value"), 0.95).alias("p95"), F.count(F.when(F.col("status") == "warning", 1)).alias("warning"), F.count(F.when(F.col("status") == "degraded", 1)).alias("degraded"))


@register("document_coverage", "SELECT conv_id, round(len(list_intersect(e, f)) / greatest(len(list_distinct(e)), 1), 4) AS coverage, len(list_filter(list_distinct(e), lambda x: NOT list_contains(f, x)))::INT AS missing FROM (SELECT conv_id, coalesce(flatten(list(string_split(text, ' ')) FILTER (role = 'user')), []) AS e, coalesce(flatten(list(string_split(text, ' ')) FILTER (role = 'assistant')), []) AS f FROM conversations GROUP BY ALL)")
def document_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Expected names (the words of a conversation's questions) found among the cited ones (those of its answers), and how
    many are missing."""
    c = _T(spark, sf, "conversations")
    said = lambda r, name: c.where(F.col("role") == r).select("conv_id", F.explode(F.split("text", " ")).alias("word")).distinct().withColumn(name, F.lit(1))
    words = said("user", "e").join(said("assistant", "f"), ["conv_id", "word"], "left").groupBy("conv_id")
    counts = words.agg(F.count(F.lit(1)).alias("e"), F.count("f").alias("both"))  # no conversation's words are gathered
    rows = c.select("conv_id").distinct().join(counts, "conv_id", "left").fillna(0, ["e", "both"])
    return rows.select("conv_id", F.round(F.col("both") / F.greatest("e", F.lit(1)), 4).alias("coverage"), (F.col("e") - F.col("both")).cast("int").alias("missing"))


@register("citation_coverage", adapters.sql("SELECT g.query_id, round(count(*) FILTER (EXISTS (SELECT 1 FROM children c WHERE c.document_id = g.document_id AND c.position % 2 = 0 AND c.start_offset < g.end_offset AND g.start_offset < c.end_offset)) / count(*), 4) AS coverage FROM gold g GROUP BY ALL"))
def citation_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of gold spans overlapped by a citation (here every second chunk)."""
    from ..operators.metrics import overlaps

    docs = adapters.documents(spark, sf)
    gold = adapters.gold_spans(docs, spark, sf).withColumn("span", F.struct("document_id", "start_offset"))
    cited = adapters.children(docs).where("position % 2 = 0")
    hit = gold.alias("g").join(cited.alias("c"), (F.col("g.document_id") == F.col("c.document_id")) & overlaps("g", "c"), "left_semi").select("query_id", "span", F.lit(1).alias("hit"))
    return gold.join(hit, ["query_id", "span"], "left").groupBy("query_id").agg(F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("coverage"))


_CUES = "cues AS (SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN 'Compare ' WHEN 1 THEN 'please summarize the overview of ' WHEN 2 THEN '比較差異 ' WHEN 3 THEN '摘要 ' WHEN 4 THEN 'vst summarizes ' ELSE '' END || text AS q FROM conversations)"


def _hits_sql(han: list[str], latin: list[str]) -> str:
    tests = [f"CASE WHEN contains(q, '{p}') THEN 1 ELSE 0 END" for p in han] + [f"CASE WHEN regexp_matches(lower(q), '(^|[^a-z0-9]){p}([^a-z0-9]|$)') THEN 1 ELSE 0 END" for p in latin]
    return "(" + " + ".join(tests) + ")"


@register("routing_rules", f"WITH {_CUES}, h AS (SELECT conv_id, turn, {_hits_sql(routing.COMPARE_HAN, routing.COMPARE_LATIN)} AS c, {_hits_sql(routing.SUMMARY_HAN, routing.SUMMARY_LATIN)} AS s FROM cues) SELECT conv_id, turn, CASE WHEN c > 0 THEN 'cross_document_compare' WHEN s > 0 THEN 'document_summary' END AS label, CASE WHEN CASE WHEN c > 0 THEN c ELSE s END >= 2 THEN 0.92 WHEN CASE WHEN c > 0 THEN c ELSE s END = 1 THEN 0.84 ELSE 0 END::DOUBLE AS confidence FROM h")
def routing_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Task type of each turn by the trigger rules."""
    cue = F.element_at(F.array(*[F.lit(x) for x in ("Compare ", "please summarize the overview of ", "比較差異 ", "摘要 ", "vst summarizes ", "")]), (F.col("conv_id") % 6 + 1).cast("int"))
    c = _T(spark, sf, "conversations").select("conv_id", "turn", routing.task_type(F.concat(cue, F.col("text"))).alias("t"))
    return c.select("conv_id", "turn", "t.label", "t.confidence")


_DECIDED = f"""
WITH h AS (SELECT conv_id, turn, {_hits_sql(routing.COMPARE_HAN, routing.COMPARE_LATIN)} AS c, {_hits_sql(routing.SUMMARY_HAN, routing.SUMMARY_LATIN)} AS s FROM (SELECT *, text AS q FROM conversations)),
r AS (SELECT *, CASE WHEN c > 0 THEN 'cross_document_compare' WHEN s > 0 THEN 'document_summary' END AS rule, conv_id % 100 >= 78 AS sure FROM h)
SELECT conv_id, turn, CASE WHEN turn = 7 THEN 'fact_lookup' WHEN rule IS NOT NULL THEN rule WHEN sure THEN 'document_summary' ELSE 'fact_lookup' END AS label,
  CASE WHEN turn = 7 THEN 'explicit' WHEN rule IS NOT NULL THEN 'rule' WHEN sure THEN 'embedding' ELSE 'fallback' END AS source FROM r
"""


@register("routing_decision", _DECIDED)
def routing_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Explicit, rule, embedding and fallback stages of each turn's label; tested on hand-made cases."""
    c = _T(spark, sf, "conversations").withColumn("t", routing.task_type(F.col("text")))
    explicit = F.when(F.col("turn") == 7, "fact_lookup")
    d = routing.decide(explicit, F.col("t.label"), F.lit("document_summary"), (F.col("conv_id") % 100) / 100, F.lit(0.06), "fact_lookup")
    return c.select("conv_id", "turn", d.alias("d")).select("conv_id", "turn", "d.*")



@register("routing_profiles", _DECIDED.rstrip().replace("WITH h AS", "WITH p(query_type, vector_top_k, max_contexts, max_chars, max_children, document_recall_top_k) AS (VALUES ('fact_lookup', 30, 9, 3000, 7, 6), ('document_summary', 45, 12, 3600, 7, 1), ('document_summary', 45, 12, 3600, 7, 6), ('cross_document_compare', 45, 12, 3200, 7, 8)), h AS", 1).replace("SELECT conv_id, turn, CASE WHEN turn = 7", ", d AS (SELECT conv_id, turn, CASE WHEN turn = 7", 1) + ") SELECT p.*, count(d.conv_id) AS turns FROM p LEFT JOIN d ON d.label = p.query_type GROUP BY ALL")
def routing_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """The settings of each profile and how many turns are decided for its kind of question."""
    turns = routing_decision(spark, sf).groupBy(F.col("label").alias("query_type")).agg(F.count(F.lit(1)).alias("turns"))
    p = routing.profiles(spark).select("query_type", "vector_top_k", "max_contexts", "max_chars", "max_children", "document_recall_top_k")
    return p.join(turns, "query_type", "left").fillna(0, ["turns"])


_MEANING = {k: [w for w in dict.fromkeys(v.replace(",", "").split())] for k, v in fallback.TASK_TYPES.items()}
_SHARED_WORDS = ", ".join(f"len(list_intersect(w, [{', '.join(repr(x) for x in words)}]))" for words in _MEANING.values())


@register(
    "label_fallback",
    f"""WITH dec AS ({_DECIDED}), w AS (SELECT dec.*, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda t: t <> '')) AS w FROM dec JOIN conversations USING (conv_id, turn)),
s AS (SELECT *, [{_SHARED_WORDS}] AS n FROM w),
m AS (SELECT *, list_max(n) AS best, list_position(n, list_max(n)) AS best_at FROM s)
SELECT conv_id, turn, CASE WHEN source <> 'fallback' OR best = 0 THEN label ELSE [{', '.join(repr(k) for k in _MEANING)}][best_at] END AS label, CASE WHEN source = 'fallback' AND best > 0 THEN 'llm_fallback' ELSE source END AS source,
  round(CASE WHEN source <> 'fallback' THEN 1 WHEN best > 0 THEN best / len(w)::DOUBLE ELSE 0 END::DOUBLE, 9) AS confidence, source = 'fallback' AND best > 0 AS fallback_used,
  CASE WHEN source = 'fallback' THEN CASE WHEN best > 0 THEN 'low_embedding_confidence' ELSE 'llm_fallback_unavailable' END END AS fallback_reason FROM m""",
)
def label_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn's task type with a deterministic model for the turns that rules and embeddings leave undecided."""
    texts = _T(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("query_text"))
    rows = routing_decision(spark, sf).join(texts, ["conv_id", "turn"]).withColumn("language", F.lit("en")).withColumn("context", F.lit("{}")).withColumn("confidence", F.lit(1.0))
    label = fallback.label_udf(fallback.word_model, "task_type", fallback.TASK_TYPES)
    out = fallback.with_fallback(rows, label, F.array(*map(F.lit, fallback.TASK_TYPES)), F.lit("fact_lookup"))
    return out.select("conv_id", "turn", "label", "source", F.round("confidence", 9).alias("confidence"), "fallback_used", "fallback_reason")


@register(
    "settings_trace",
    f"""SELECT conv_id, turn, query_type, summary_scope, margin, fallback_used, CASE query_type WHEN 'fact_lookup' THEN 30 ELSE 45 END AS vector_top_k, CASE query_type WHEN 'fact_lookup' THEN 30 ELSE 45 END AS fts_top_k, CASE query_type WHEN 'fact_lookup' THEN 30 ELSE 45 END AS max_candidates,
    query_type <> 'fact_lookup' AS document_recall, CASE WHEN query_type = 'cross_document_compare' THEN 8 WHEN summary_scope = 'single_document' THEN 1 ELSE 6 END AS document_recall_top_k, CASE query_type WHEN 'fact_lookup' THEN 30 ELSE 36 END AS rerank_top_n,
    CASE query_type WHEN 'fact_lookup' THEN 9 ELSE 12 END AS max_contexts, CASE query_type WHEN 'fact_lookup' THEN 3000 WHEN 'document_summary' THEN 3600 ELSE 3200 END AS max_chars, CASE query_type WHEN 'cross_document_compare' THEN 5 ELSE 7 END AS max_children, max_contexts AS selection_max_contexts
    FROM (SELECT conv_id, turn, label AS query_type, CASE WHEN label = 'document_summary' THEN CASE turn % 2 WHEN 0 THEN 'single_document' ELSE 'multi_document' END END AS summary_scope, 0.06::DOUBLE AS margin, source = 'fallback' AS fallback_used FROM ({_DECIDED}))""",
)
def settings_trace(spark: SparkSession, sf: str) -> DataFrame:
    """The settings in effect for every turn, with what its label rests on."""
    scope = F.when(F.col("label") == "document_summary", F.when(F.col("turn") % 2 == 0, "single_document").otherwise("multi_document"))
    d = routing_decision(spark, sf).select("conv_id", "turn", F.col("label").alias("query_type"), scope.alias("summary_scope"), F.lit(0.06).alias("margin"), (F.col("source") == "fallback").alias("fallback_used"))
    return routing.settings_trace(d, routing.profiles(spark))


_STRATEGY = f"""
WITH c AS (SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN 'focus on the ' WHEN 1 THEN '請聚焦章節 ' WHEN 2 THEN 'partial ' ELSE '' END || text AS q, conv_id % 3 AS resolved, CASE turn % 3 WHEN 0 THEN 'single_document' WHEN 1 THEN 'multi_document' ELSE 'area' END AS scope,
  CASE WHEN turn % 7 = 6 THEN 'section_focused' END AS explicit, CASE WHEN conv_id % 9 = 8 THEN 'fact_lookup' ELSE 'document_summary' END AS query_type, CASE conv_id % 2 WHEN 0 THEN 'multi_document_theme' ELSE 'document_overview' END AS embedded, conv_id % 100 / 100.0 AS confidence FROM conversations),
h AS (SELECT *, {_hits_sql(routing.SECTION_HAN, routing.SECTION_LATIN)} AS n, resolved >= 2 OR scope = 'multi_document' AS several FROM c),
r AS (SELECT *, CASE WHEN several THEN 'multi_document_theme' WHEN resolved = 1 AND n > 0 THEN 'section_focused' END AS rule, CASE WHEN several THEN 0.9 WHEN n >= 2 THEN 0.92 ELSE 0.84 END AS rule_score,
  confidence >= 0.8 AND NOT (resolved = 1 AND embedded = 'multi_document_theme') AND NOT (resolved >= 2 AND embedded <> 'multi_document_theme') AS sure FROM h),
d AS (SELECT *, CASE WHEN query_type <> 'document_summary' THEN 'not_applicable' WHEN explicit IS NOT NULL THEN 'explicit' WHEN rule IS NOT NULL THEN 'rule' WHEN sure THEN 'embedding' ELSE 'fallback' END AS source FROM r),
l AS (SELECT *, CASE source WHEN 'not_applicable' THEN '' WHEN 'explicit' THEN explicit WHEN 'rule' THEN rule WHEN 'embedding' THEN embedded ELSE CASE WHEN scope = 'single_document' AND resolved = 1 THEN 'document_overview' ELSE 'multi_document_theme' END END AS label FROM d)
SELECT conv_id, turn, label, source, round(CASE source WHEN 'explicit' THEN 1 WHEN 'rule' THEN rule_score WHEN 'embedding' THEN confidence ELSE 0 END::DOUBLE, 6) AS confidence, CASE WHEN source = 'fallback' THEN 'llm_fallback_unavailable' END AS reason,
  CASE WHEN query_type = 'document_summary' THEN CASE WHEN label <> 'multi_document_theme' AND scope = 'single_document' AND resolved = 1 THEN 'single_document' ELSE 'multi_document' END END AS summary_scope FROM l
"""


@register("summary_strategy", _STRATEGY)
def summary_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """Strategy and scope of a summary for each turn, with made-up mentions, scopes and embedding labels."""
    c = F.col("conv_id")
    cue = F.when(c % 6 == 0, "focus on the ").when(c % 6 == 1, "請聚焦章節 ").when(c % 6 == 2, "partial ").otherwise("")
    kind = F.when(c % 9 == 8, "fact_lookup").otherwise("document_summary")
    scope = F.when(F.col("turn") % 3 == 0, "single_document").when(F.col("turn") % 3 == 1, "multi_document").otherwise("area")
    embedded = F.when(c % 2 == 0, "multi_document_theme").otherwise("document_overview")
    s = routing.summary_strategy(F.concat(cue, "text"), kind, c % 3, scope, F.when(F.col("turn") % 7 == 6, "section_focused"), embedded, c % 100 / 100, F.lit(0.06))
    out = _T(spark, sf, "conversations").select("conv_id", "turn", s.alias("s"), kind.alias("kind"), scope.alias("scope"))
    return out.select("conv_id", "turn", "s.label", "s.source", F.round("s.confidence", 6).alias("confidence"), "s.reason", routing.summary_scope(F.col("kind"), c % 3, F.col("scope"), F.col("s.label")).alias("summary_scope"))


_GENERIC = ", ".join(f"'{t}'" for t in text.GENERIC_TERMS)
_MENTIONS = rf"""
WITH stems AS (SELECT doc_id AS document_id, source AS area_id, lang, trim(regexp_replace(regexp_replace(substr(text, 1, 24), '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g')) AS heading FROM documents WHERE doc_id % 17 <> 0 AND text IS NOT NULL),
files AS (SELECT *, lang || '-' || document_id || ' ' || heading AS stem FROM stems),
named AS (SELECT *, stem || '.md' AS file_name, trim(regexp_replace(lower(stem), '[-_./()\[\]{{}} ]+', ' ', 'g')) AS name FROM files),
names AS (SELECT *, list_filter(list_distinct(regexp_extract_all(name, '[a-z0-9][a-z0-9._/-]*')), lambda t: t NOT IN ({_GENERIC})) AS tokens FROM named),
parts AS (SELECT DISTINCT area_id, document_id, trim(regexp_replace(unnest(regexp_split_to_array(lower(stem), '[-_/]+')), '[-_./()\[\]{{}} ]+', ' ', 'g')) AS part FROM files),
owned AS (SELECT area_id, part, min(document_id) AS document_id FROM parts WHERE contains(part, ' ') OR length(part) >= 8 GROUP BY ALL HAVING count(*) = 1),
df AS (SELECT area_id, token, count(*) AS df FROM (SELECT area_id, unnest(tokens) AS token FROM names) GROUP BY ALL),
asked0 AS (ASKED),
asked AS (SELECT *, list_filter(list_distinct(regexp_extract_all(q, '[a-z0-9][a-z0-9._/-]*')), lambda t: t NOT IN ({_GENERIC})) AS q_tokens FROM asked0 WHERE q <> ''),
pairs AS (SELECT a.query_id, a.q, a.q_tokens, n.*, len(list_filter(a.q_tokens, lambda t: length(t) >= 4)) > 0 AS telling, list_filter(a.q_tokens, lambda t: list_contains(n.tokens, t)) AS shared FROM asked a JOIN names n ON a.area_id = n.area_id),
bonus AS (SELECT query_id, document_id, least(sum(CASE df WHEN 1 THEN 12 WHEN 2 THEN 6 ELSE 1 END), 30) AS b FROM (SELECT query_id, document_id, area_id, unnest(shared) AS token FROM pairs) JOIN df USING (area_id, token) GROUP BY ALL),
held AS (SELECT p.query_id, p.document_id, TRUE AS held FROM pairs p JOIN owned o USING (area_id, document_id) WHERE contains(p.q, o.part) GROUP BY ALL),
scores AS (SELECT p.query_id, p.document_id, p.file_name, p.q = p.name OR (telling AND (coalesce(held, FALSE) OR (contains(q, name) AND (contains(name, ' ') OR length(name) >= 8)))) AS strong,
  round(CASE WHEN q = name THEN 1.0 WHEN NOT telling THEN 0.0 ELSE greatest(CASE WHEN contains(q, name) AND (contains(name, ' ') OR length(name) >= 8) THEN 0.96 ELSE 0 END, CASE WHEN held THEN 0.94 ELSE 0 END,
    CASE WHEN contains(name, q) AND (contains(q, ' ') OR length(q) >= 8) THEN 0.86 ELSE 0 END,
    CASE WHEN len(shared) > 0 THEN least(0.42::DOUBLE + 0.18::DOUBLE * len(shared) / least(len(q_tokens), len(tokens)) + b / 100.0::DOUBLE, 1.0) ELSE 0 END) END::DOUBLE, 12) AS score
  FROM pairs p LEFT JOIN held h USING (query_id, document_id) LEFT JOIN bonus USING (query_id, document_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lower(file_name), document_id) AS place FROM scores WHERE score >= 0.68 QUALIFY place <= 5),
lists AS (SELECT query_id, list(document_id ORDER BY place) AS ids, list(document_id ORDER BY place) FILTER (score >= 0.8) AS several, max(score) AS s1, coalesce(max(score) FILTER (place = 2), 0) AS s2, max(strong::INT) FILTER (place = 1) AS strong1, max(strong::INT) FILTER (place = 2) AS strong2 FROM top GROUP BY ALL)
"""
_OWN = "SELECT document_id AS query_id, area_id, name AS q FROM named"
_ABOUT = """SELECT document_id AS query_id, area_id, trim(lower(CASE document_id % 4 WHEN 0 THEN 'tell me about ' || heading WHEN 1 THEN 'about ' || document_id || ' ' || heading WHEN 2 THEN heading
  ELSE 'compare the ' || heading || ' files' END)) AS q FROM named WHERE heading <> ''"""
_RESOLVE = """SELECT query_id, CASE WHEN s1 >= 0.9 AND strong1 = 1 AND (strong2 IS NULL OR (strong2 = 0 AND round(s1 - s2, 12) >= 0.05)) THEN ids[1:1] WHEN len(several) >= 2 THEN several WHEN s1 >= 0.8 AND round(s1 - s2, 12) >= 0.12 THEN ids[1:1] ELSE ids[1:0] END AS resolved, s1 AS confidence FROM lists"""


def _named(spark: SparkSession, sf: str) -> DataFrame:
    """Ready documents with file names of language, id and the words of their heading."""
    words = F.trim(F.regexp_replace(F.regexp_replace("heading", "[^A-Za-z ]", ""), " +", " "))
    docs = adapters.documents(spark, sf).where("status = 'ready' and display_text is not null").withColumn("words", words)
    return docs.select("document_id", "area_id", "words", F.concat("lang", F.lit("-"), "document_id", F.lit(" "), "words", F.lit(".md")).alias("file_name"))


@register("mention_resolution", _MENTIONS.replace("ASKED", _OWN) + _RESOLVE)
def mention_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that questions name (here: questions made from every document's name)."""
    docs = _named(spark, sf)
    own = docs.select(F.col("document_id").alias("query_id"), "area_id", F.concat(F.lit("summarize "), text.document_name(F.col("file_name"))).alias("query_text"))
    return mentions.resolve_mentions(mentions.mention_scores(own, docs))


def _about(docs: DataFrame) -> DataFrame:
    kind, w = F.col("document_id") % 4, F.col("words")
    q = F.when(kind == 0, F.concat(F.lit("tell me about "), w)).when(kind == 1, F.concat(F.lit("about "), F.col("document_id"), F.lit(" "), w)).when(kind == 2, w).otherwise(F.concat(F.lit("compare compare the "), w, F.lit(" files")))
    return docs.where("words <> ''").select(F.col("document_id").alias("query_id"), "area_id", q.alias("query_text"))


@register("mention_ranking", _MENTIONS.replace("ASKED", _ABOUT) + "SELECT query_id, document_id, score, strong, place FROM top")
def mention_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The first documents of each question about a heading: names held, parts held, names that hold it, shared words."""
    docs = _named(spark, sf)
    return mentions.mention_scores(_about(docs), docs).drop("file_name")


@register("mention_scope", _MENTIONS.replace("ASKED", _ABOUT) + _RESOLVE)
def mention_scope(spark: SparkSession, sf: str) -> DataFrame:
    """What questions about headings resolve to."""
    docs = _named(spark, sf)
    return mentions.resolve_mentions(mentions.mention_scores(_about(docs), docs))


@register("event_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: hourly windows over events."""
    e = _T(spark, sf, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select("event_type", F.col("w.start").alias("window_start"), "n", "total")


@register("event_sessions", "SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM events)) GROUP BY user_id, s")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: sessions of a user with gaps under six hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.when(F.col("ts") - F.lag("ts").over(w) < F.expr("INTERVAL '6' HOUR"), 0).otherwise(1)
    e = _T(spark, sf, "events").withColumn("g", gap).withColumn("s", F.sum("g").over(w))
    return e.groupBy("user_id", "s").agg(F.min("ts").alias("session_start"), F.count(F.lit(1)).alias("n")).drop("s")


_JOBS = "jobs AS (SELECT user_id AS document_id, arg_max(event_type, (ts, event_id)) AS last_type, count(*) AS events, max(ts) AS updated_at FROM events GROUP BY ALL)"


@register("ingest_jobs", f"WITH {_JOBS} SELECT document_id, CASE last_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'processing' ELSE 'queued' END AS status, events, updated_at FROM jobs")
def ingest_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Latest state of each document's ingest job."""
    from ..streaming.ingest import job_status

    e = _T(spark, sf, "events").groupBy(F.col("user_id").alias("document_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count(F.lit(1)).alias("events"), F.max("ts").alias("updated_at"))
    return e.select("document_id", job_status(F.col("last_type")).alias("status"), "events", "updated_at")


@register("evidence_alignment")
def evidence_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Passages against the documents that hold any of their anchors: exact after normalising, else fuzzy lines."""
    from ..operators import align

    docs = adapters.documents(spark, sf).where("status = 'ready'")
    asked = _T(spark, sf, "benchmark").select("item_id", F.col("text").alias("evidence"))
    passages = adapters.passages(spark, sf)
    if len(passages) > adapters.PATTERNS:
        raise ValueError(f"more than {adapters.PATTERNS} passages: align them in blocks")
    anchors = [(item, a) for item, evidence in passages for a in align.anchors(evidence or "")]
    flat = align.flat(docs, "document_id", "display_text")
    blocks = [adapters.exact_matches(flat, "document_id", "flat", anchors[k : k + adapters.PATTERNS]) for k in range(0, len(anchors) or 1, adapters.PATTERNS)]
    near = functools.reduce(DataFrame.union, blocks).select(F.col("id").alias("document_id"), F.col("passage_id").alias("item_id")).distinct()
    pairs = near.join(docs.select("document_id", "display_text"), "document_id").join(asked, "item_id")
    return align.align(pairs.withColumn("signal", F.col("evidence")))


_SNIPPETS = "(SELECT conv_id AS query_id, arg_min(text, turn) AS query, CASE WHEN conv_id % 3 = 0 THEN ['[]'] WHEN conv_id % 3 = 1 THEN ['well ' || conv_id] ELSE [] END AS well_formed, CASE WHEN conv_id % 2 = 0 THEN ['No Answer Present.'] ELSE ['short'] END AS answers, list({text: text, selected: (turn % 2)::INT} ORDER BY turn) AS p FROM conversations GROUP BY ALL)"


@register("prepare_snippets", f"SELECT query_id AS source_document_id, 'msmarco-' || query_id || '.md' AS file_name, CASE WHEN query_id % 3 = 1 THEN 'well_formed_answer' ELSE 'short_answer' END AS answer_type, len(list_filter(p, lambda x: x.selected = 1))::INT AS selected_passages, least(len(list_filter(p, lambda x: x.selected <> 1)), 3)::INT AS context_passages FROM {_SNIPPETS} WHERE trim(query) <> '' AND (query_id % 3 = 1 OR query_id % 2 = 1) AND len(list_filter(p, lambda x: x.selected = 1)) > 0")
def prepare_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """Snippet bundles with an answer and a selected passage."""
    from ..operators import prepare

    passage = F.struct("turn", F.struct("text", F.lit("http://x").alias("url"), (F.col("turn") % 2).cast("int").alias("selected")).alias("p"))
    g = _T(spark, sf, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("query"), F.sort_array(F.collect_list(passage)).alias("l"))
    none = F.array().cast("array<string>")
    well = F.when(F.col("query_id") % 3 == 0, F.array(F.lit("[]"))).when(F.col("query_id") % 3 == 1, F.array(F.concat(F.lit("well "), F.col("query_id").cast("string")))).otherwise(none)
    answers = F.when(F.col("query_id") % 2 == 0, F.array(F.lit(prepare.NO_ANSWER))).otherwise(F.array(F.lit("short")))
    rows = g.select("query_id", "query", well.alias("well_formed"), answers.alias("answers"), F.transform("l", lambda x: x["p"]).alias("passages"))
    return prepare.snippet_bundles(rows).select("source_document_id", "file_name", "answer_type", "selected_passages", "context_passages")


@register("prepare_reading", "SELECT doc_id AS source_document_id, s AS answer_start, substr(text, s + 1, 12) AS answer_text, trim(substr(text, greatest(s - 80, 0) + 1, least(s + 12 + 80, length(text)) - greatest(s - 80, 0))) AS evidence FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN length(text) // 4 ELSE length(text) // 8 END::INT AS s FROM documents) WHERE trim(substr(text, s + 1, 12)) <> ''")
def prepare_reading(spark: SparkSession, sf: str) -> DataFrame:
    """Reading-comprehension questions on every text: the answer by vote (a quarter in twice against an eighth in once, or a tie to the earlier), evidence around it."""
    from ..operators import prepare

    at = lambda part: F.floor(F.length("text") / part).cast("int")
    a = lambda part: F.struct(F.substring("text", at(part) + 1, F.lit(12)).alias("text"), at(part).alias("start"))
    answers = F.when(F.col("doc_id") % 2 == 0, F.array(a(8), a(4), a(4))).otherwise(F.array(a(4), a(8)))
    qas = F.array(F.struct(F.lit("q").alias("id"), F.lit("what?").alias("question"), answers.alias("answers")))
    d = _T(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), F.lit(0).alias("paragraph_id"), F.col("text").alias("context"), qas.alias("qas"))
    return prepare.reading_items(d).select("source_document_id", "answer_start", "answer_text", "evidence")
