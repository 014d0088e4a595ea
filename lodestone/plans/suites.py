"""Queries over scorers, judges and resumable runs; answers and references are turns of conversations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scorers, snapshots, suites
from ..sources import adapters
from ..sources.scratch import folder
from ..streaming import chat
from .catalog import register
from .evaluation import _JUDGED, _judged

_ITEMS = "items AS (SELECT conv_id AS item_id, max(text) FILTER (turn = 0) AS question, max(text) FILTER (turn = 1) AS reference, arg_max(text, turn) AS answer, count(*) AS turns FROM conversations GROUP BY conv_id)"


def _tokens(side: str) -> str:
    return rf"list_filter(string_split_regex(lower(coalesce({side}, '')), '\s+'), lambda t: t <> '')"


_VECTOR = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::UBIGINT::DOUBLE / 4294967295.0::DOUBLE * 2 - 1" for i in range(8))
_ALIGNED = f"""
{_ITEMS},
tok AS (SELECT item_id, side, token, count(*) AS n, sha256(token || chr(0) || '0') AS h FROM
  (SELECT item_id, 'a' AS side, unnest({_tokens("answer")}) AS token FROM items UNION ALL SELECT item_id, 'r', unnest({_tokens("reference")}) FROM items) GROUP BY ALL),
vec AS (SELECT item_id, side, n, [{_VECTOR}] AS v FROM tok),
near AS (SELECT a.item_id, a.side, a.v, a.n, max(list_cosine_similarity(a.v, b.v)) AS best FROM vec a JOIN vec b ON a.item_id = b.item_id AND a.side <> b.side GROUP BY ALL),
parts AS (SELECT item_id, sum(n * best) FILTER (side = 'a') / sum(n) FILTER (side = 'a') AS p, sum(n * best) FILTER (side = 'r') / sum(n) FILTER (side = 'r') AS r FROM near GROUP BY ALL),
aligned AS (SELECT item_id, CASE WHEN len({_tokens("answer")}) = 0 THEN NULL ELSE round(coalesce(p, 0), 6) END AS precision, CASE WHEN len({_tokens("answer")}) = 0 THEN NULL ELSE round(coalesce(r, 0), 6) END AS recall,
  CASE WHEN len({_tokens("answer")}) = 0 THEN NULL WHEN coalesce(p + r, 0) > 0 THEN round(2 * p * r / (p + r), 6) ELSE 0 END AS f1,
  CASE WHEN len({_tokens("answer")}) = 0 THEN 'not_applicable' ELSE 'scored' END AS status FROM items LEFT JOIN parts USING (item_id))
"""
_SHARED = lambda x, y: f"len(list_intersect(list_distinct({x}), list_distinct({y})))"
_COUNTS = f"""
counted AS (SELECT item_id, turns, {_SHARED(_tokens("question"), _tokens("answer"))} AS a, {_SHARED(_tokens("question"), _tokens("reference"))} AS b,
  len(list_distinct({_tokens("question")})) AS q, len(list_distinct({_tokens("answer")})) AS aw, len(list_distinct({_tokens("reference")})) AS rw,
  {_SHARED(_tokens("answer"), _tokens("reference"))} AS ar, answer FROM items),
verdicts AS (SELECT item_id, turns, CASE WHEN a > b THEN 'candidate' WHEN a < b THEN 'reference' ELSE 'tie' END AS verdict FROM counted),
rubric AS (SELECT item_id, floor(100 * (1 + 4.0::DOUBLE * a / greatest(q, 1)) + 0.5) / 100 AS completeness, floor(100 * (1 + 4.0::DOUBLE * ar / greatest(aw, 1)) + 0.5) / 100 AS faithfulness_to_citations,
  CASE WHEN contains(answer, chr(10)) OR contains(answer, '. ') THEN 5.0::DOUBLE ELSE 3.0::DOUBLE END AS structure_quality, floor(100 * (1 + 4.0::DOUBLE * ar / greatest(rw, 1)) + 0.5) / 100 AS compare_coverage FROM counted)
"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    c = adapters.table(spark, sf, "conversations")
    turn = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    return c.groupBy(F.col("conv_id").alias("item_id")).agg(turn(0).alias("question"), turn(1).alias("reference"), F.max_by("text", "turn").alias("answer"), F.count(F.lit(1)).alias("turns"))


@register("token_alignment", f"WITH {_ALIGNED.strip()} SELECT * FROM aligned")
def token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall and F1 of each conversation's last turn against its second."""
    s = scorers.alignment_udf()("answer", "reference")
    return _items(spark, sf).select("item_id", s.alias("s")).select("item_id", "s.precision", "s.recall", "s.f1", "s.status")


def _verdicts(items: DataFrame) -> DataFrame:
    return items.withColumn("v", scorers.pairwise_udf(scorers.word_judge)("question", "answer", "reference")).select("item_id", "turns", "v.*")


@register("pairwise_win_rates", f"WITH {_ITEMS}, {_COUNTS.strip()} SELECT turns, count(*) AS items, round(avg(CASE verdict WHEN 'candidate' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0 END::DOUBLE), 6) AS win_rate, count(*) FILTER (verdict = 'tie') AS ties FROM verdicts GROUP BY turns")
def pairwise_win_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Win rates of last against second turns, judged in both orders, by the length of the conversation."""
    out = _verdicts(_items(spark, sf)).groupBy("turns")
    return out.agg(F.count(F.lit(1)).alias("items"), F.round(F.avg("score"), 6).alias("win_rate"), F.count(F.when(F.col("verdict") == "tie", 1)).alias("ties"))


@register("rubric_scores", f"WITH {_ITEMS}, {_COUNTS.strip()} SELECT *, round((completeness + faithfulness_to_citations + structure_quality + compare_coverage) / 4, 4) AS overall FROM rubric")
def rubric_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The four dimensions of a deterministic rubric judge and their mean."""
    r = scorers.rubric_udf(scorers.word_rubric)("question", "answer", "reference")
    return _items(spark, sf).select("item_id", r.alias("r")).select("item_id", *[f"r.{d}" for d in scorers.DIMENSIONS], "r.overall")


@register(
    "suite_run",
    f"WITH {_ALIGNED.strip()}, {_COUNTS.strip()} SELECT family, count(*) AS items, round(avg(CASE WHEN family = 'summary' THEN f1 ELSE CASE verdict WHEN 'candidate' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0 END::DOUBLE END), 4) AS value, count(DISTINCT wave) AS waves "
    "FROM (SELECT *, CASE WHEN item_id % 2 = 0 THEN 'summary' ELSE 'compare' END AS family, (row_number() OVER (ORDER BY item_id) - 1) // 2000 AS wave FROM aligned JOIN verdicts USING (item_id)) GROUP BY family",
)
def suite_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run of all conversations as items in waves of 2000: summaries scored by alignment, comparisons by the judge."""

    def work(items: DataFrame) -> DataFrame:
        family = F.when(F.col("item_id") % 2 == 0, "summary").otherwise("compare")
        both = items.withColumn("family", family).withColumn("s", scorers.alignment_udf()("answer", "reference")).withColumn("v", scorers.pairwise_udf(scorers.word_judge)("question", "answer", "reference"))
        summary = F.col("family") == "summary"
        return both.select("item_id", "family", F.when(summary, F.col("s.f1")).otherwise(F.col("v.score")).alias("value"), F.when(summary, F.col("s.status")).otherwise(F.col("v.status")).alias("status"))

    held = suites.run(_items(spark, sf), work, folder(spark, "run"), {"judge": "words"}, wave=2000)
    return held.groupBy("family").agg(F.count(F.lit(1)).alias("items"), F.round(F.avg("value"), 4).alias("value"), F.count_distinct("wave").alias("waves"))


_FOUR = [("Task Type Accuracy", "task_type_accuracy"), ("Summary Strategy Accuracy", "summary_strategy_accuracy"), ("Required Document Coverage", "required_document_coverage"), ("Citation Coverage", "citation_coverage"), ("Section Coverage", "section_coverage"), ("Fallback Rate", "fallback_rate"), ("Avg Faithfulness", "avg_faithfulness_to_citations"), ("Avg Overall Score", "avg_overall_score"), ("p95 Latency", "p95_latency_seconds")]


def _report_sql() -> str:
    from ..operators import gates
    from .evaluation import _AGG, _GATE_ROWS

    order = " ".join(f"WHEN '{n}' THEN {i}" for i, (n, *_) in enumerate(gates.GATES))
    means = " UNION ALL ".join(f"SELECT 1 AS section, '{i + 1:06d}' AS place, '- {label}: `' || printf('%.4f', {c}::DOUBLE) || '`' AS line FROM agg" for i, (label, c) in enumerate(_FOUR))
    low = "list_filter([CASE WHEN faithfulness < 4.5 THEN 'judge_low_faithfulness' END, CASE WHEN completeness < 4 THEN 'judge_low_completeness' END, CASE WHEN structure_quality < 4 THEN 'judge_low_structure_quality' END, CASE WHEN compare_coverage < 4 THEN 'judge_low_coverage' END], lambda x: x IS NOT NULL)"
    advice = ", ".join(f"CASE WHEN list_has_any(seen, [{', '.join(repr(n) for n in names)}]) THEN '- {line}' END" for names, line in suites.ADVICE)
    head = ["'# Phase 8A Summary / Compare Checkpoint'", "'- Passed: `' || (SELECT CASE WHEN bool_and(passed) THEN 'True' ELSE 'False' END FROM gate_rows) || '`'", "'- Benchmark: `labels` `v1`'", "'- Area ID: `all`'", "'- Judge Model: `words`'", "'- Thinking Mode: `False`'", "'- Answer Path: `deterministic`'", "'- Item Count: `' || (SELECT count(*) FROM judged) || '`'"]
    heads = " UNION ALL ".join(f"SELECT 0, '{i:06d}', {line}" for i, line in enumerate(head))
    return f"""WITH {_JUDGED.strip()}, {_AGG.strip()}, gate_rows AS ({_GATE_ROWS}),
seen AS (SELECT list(DISTINCT category) AS seen FROM (SELECT unnest(list_concat(blockers, {low})) AS category FROM judged)),
advice AS (SELECT list_filter([{advice}], lambda x: x IS NOT NULL) AS a FROM seen)
{means} UNION ALL {heads} UNION ALL SELECT 1, '000000', '## Aggregate Metrics' UNION ALL SELECT 1, '{len(_FOUR) + 1:06d}', '- Timeout Count: `' || timeout_count::INT || '`' FROM agg
UNION ALL SELECT 2, lpad((CASE name {order} END)::VARCHAR, 6, '0'), '- `' || name || '`: ' || CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END || ' (actual=' || printf('%.4f', actual) || ' ' || comparator || ' threshold=' || printf('%.4f', threshold) || ')' FROM gate_rows
UNION ALL SELECT 3, lpad((i - 1)::VARCHAR, 6, '0'), a[i] FROM (SELECT a, unnest(range(1, len(a) + 1)) AS i FROM advice) UNION ALL SELECT 3, '000000', '- 無' FROM advice WHERE len(a) = 0
UNION ALL SELECT 4, doc_id::VARCHAR, '- `' || doc_id || '`: blockers=' || coalesce(nullif(array_to_string(blockers, ', '), ''), 'none') || '; overall=' || printf('%.2f', overall) FROM judged WHERE len(blockers) > 0 OR overall < 3
UNION ALL SELECT 4, '', '- 無' FROM (SELECT count(*) AS n FROM judged WHERE len(blockers) > 0 OR overall < 3) WHERE n = 0"""


@register("checkpoint_report", _report_sql())
def checkpoint_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report of a checkpoint over all labelled documents, line by line."""
    items = _judged(spark, sf).withColumnRenamed("doc_id", "item_id")
    run_row = spark.range(1).select(F.lit("labels").alias("benchmark_name"), F.lit("v1").alias("version"), F.lit("all").alias("area_id"), F.lit("words").alias("judge_model"), F.lit(False).alias("thinking_mode"), F.lit("deterministic").alias("answer_path"))
    return suites.checkpoint_lines(items, run_row)


@register(
    "chat_events",
    "WITH w AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations), "
    "e AS (SELECT conv_id || '-' || turn AS thread_id, w, len(w) AS n, conv_id % 5 = 0 AND len(w) > 2 AS lost, w[2] AS gone FROM w) "
    "SELECT thread_id, md5(CASE WHEN n = 0 THEN '' ELSE array_to_string(CASE WHEN lost THEN list_concat(w[1:1], w[3:]) ELSE w END, ' ') || ' ' END) AS answer_md5, n + 3 - lost::INT AS events, 0 AS tool_calls, 'done' AS phase, n::VARCHAR AS \"references\", lost::INT AS missing FROM e",
)
def chat_events(spark: SparkSession, sf: str) -> DataFrame:
    """Answers put together from events: each turn's words as tokens, delivered twice, one word of some turns lost."""
    words = F.filter(F.split("text", " "), lambda x: x != "")
    c = adapters.table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("thread_id"), (F.col("conv_id") % 5 == 0).alias("lossy"), words.alias("w"))
    n = F.size("w")
    row = lambda seq, kind, payload: F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("type"), payload.alias("payload"))
    tokens = F.transform("w", lambda x, i: row(i + 2, chat.TOKEN, F.concat(x, F.lit(" "))))
    told = F.concat(F.array(row(F.lit(0), chat.PHASE, F.lit("searching")), row(F.lit(1), chat.REFERENCES, n.cast("string"))), tokens, F.array(row(n + 2, chat.PHASE, F.lit("done"))))
    events = c.select("thread_id", (F.col("lossy") & (n > 2)).alias("lossy"), F.explode(told).alias("e")).select("thread_id", "lossy", "e.*", F.lit(None).cast("timestamp").alias("ts")).where(~(F.col("lossy") & (F.col("seq") == 3)))
    rows = chat.ordered_batch(events.unionByName(events))
    return chat.answers(rows).select("thread_id", F.md5("answer").alias("answer_md5"), "events", "tool_calls", "phase", "references", "missing")


@register("snapshot_round_trip", adapters.sql("SELECT query_id::VARCHAR AS item_id, (document_id + 1000000)::VARCHAR AS document_id, start_offset, end_offset, grade AS relevance_grade FROM gold"))
def snapshot_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Gold spans exported as a snapshot and imported where the same files have other ids."""
    docs = adapters.documents(spark, sf)
    gold, now = adapters.gold_spans(docs, spark, sf), datetime(2024, 1, 1)
    place = folder(spark, "snapshot")
    asked = adapters.questions(spark, sf).select(F.col("query_id").cast("string").alias("item_id"), F.lit("gold").alias("dataset_id"), F.lit("fact_lookup").alias("query_type"), "query_text", F.lit("en").alias("language"), F.lit(None).cast("string").alias("notes"), F.lit(now).alias("created_at"))
    span = F.concat_ws("-", "query_id", "document_id", "start_offset")
    spans = gold.select(span.alias("span_id"), F.col("query_id").cast("string").alias("item_id"), F.col("document_id").cast("string").alias("document_id"), "start_offset", "end_offset", F.col("grade").alias("relevance_grade"), F.lit(False).alias("is_retrieval_miss"), F.lit("a").alias("created_by"), F.lit(now).alias("created_at"))
    head = spark.createDataFrame([("gold", "all", "gold", "fact_lookup", "a", now)], snapshots.TABLES["dataset"])
    snapshots.commit(spark, f"{place}/from", "gold", {"dataset": head, "items": asked, "spans": spans})
    snapshots.export_snapshot(spark, f"{place}/from", "gold", docs, f"{place}/files")
    other = docs.select((F.col("document_id") + 1_000_000).alias("document_id"), F.lit("other").alias("area_id"), "file_name", "status", "display_text")
    snapshots.import_snapshot(spark, f"{place}/files", f"{place}/to", "other", other, "b", now)
    return snapshots.table(spark, f"{place}/to", "gold", "spans").select("item_id", "document_id", "start_offset", "end_offset", "relevance_grade")
