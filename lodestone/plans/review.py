"""Queries over review windows, dataset edits, scopes, citations and the preparation of segmented and table sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets, packages, prepare, review
from ..sources import adapters
from .catalog import register

_T = adapters.table

# A conversation is a document of turns between blank lines; its first turn asks, its second answers, its third hints.
_TALKS = """talks AS (SELECT conv_id AS item_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS t, coalesce(max(text) FILTER (turn = 0), '') AS q,
  coalesce(max(text) FILTER (turn = 1), '') AS a, max(text) FILTER (turn = 2) AS h FROM conversations GROUP BY conv_id)"""
_TOKENS = r"list_distinct(regexp_extract_all(lower({}), '[A-Za-z0-9%$.,/\x{{4e00}}-\x{{9fff}}-]+'))"
_COMPACT = r"regexp_replace(lower({}), '[\s,.$()%/-]+', '', 'g')"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_WINDOWS = rf"""WITH {_TALKS}, words AS (SELECT *, regexp_extract_all(q, '[A-Za-z0-9]+') AS w FROM talks),
runs AS (SELECT item_id, lower(array_to_string(w[i:i + n - 1], ' ')) AS p, n, i FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, unnest([6, 5, 4, 3]) AS n FROM words))),
firsts AS (SELECT item_id, p, row_number() OVER (PARTITION BY item_id ORDER BY max(n) DESC, min(i)) AS r FROM runs
  WHERE p NOT IN ('what is the', 'what was the', 'how much did', 'in which year') GROUP BY item_id, p),
phrases AS (SELECT item_id, list(p) AS ps FROM firsts WHERE r <= 12 GROUP BY item_id),
blocks AS (SELECT item_id, q, a, h, t, b, unnest(range(1, len(b) + 1)) AS i FROM (SELECT *, string_split(t, chr(10) || chr(10)) AS b FROM talks)),
placed AS (SELECT *, b[i] AS piece, (sum(length(b[i]) + 2) OVER (PARTITION BY item_id ORDER BY i) - length(b[i]) - 2)::INT AS s FROM blocks),
cut AS (SELECT *, substr({_STRIP.format('piece')}, 1, 1400) AS x, sum(CASE WHEN {_STRIP.format('piece')} <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY i)::INT AS n FROM placed),
scored AS (SELECT c.item_id, s, x, n, {_TOKENS.format('x')} AS xt, {_TOKENS.format("concat_ws(' ', q, a, h)")} AS qt,
  length({_STRIP.format('a')}) >= 3 AND contains({_COMPACT.format('x')}, {_COMPACT.format(_STRIP.format('a'))}) AS has_a,
  h IS NOT NULL AND length({_STRIP.format('h')}) >= 3 AND contains({_COMPACT.format('x')}, {_COMPACT.format(_STRIP.format('h'))}) AS has_h,
  coalesce(len(list_filter(ps, lambda p: contains(lower(x), p))) > 0, false) AS has_p FROM cut c LEFT JOIN phrases USING (item_id) WHERE x <> ''),
summed AS (SELECT item_id, s, x, n, round(CASE WHEN len(xt) = 0 OR len(qt) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(xt, qt))::DOUBLE / len(list_distinct(xt || qt)) END
  + CASE WHEN has_a THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN has_h THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN has_p THEN 0.45::DOUBLE ELSE 0 END, 6) AS score FROM scored),
single AS (SELECT * FROM summed WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id, {_STRIP.format('substr(x, 1, 240)')} ORDER BY score DESC, s) = 1),
best AS (SELECT * FROM single QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, s) <= 12),
shown AS (SELECT item_id, 'W' || n AS window_id, s AS start_offset, (s + length(x))::INT AS end_offset, x AS window_text, score FROM best
  UNION ALL SELECT item_id, 'W1', 0, length(substr(t, 1, 1400))::INT, substr(t, 1, 1400), 0.0 FROM talks WHERE item_id NOT IN (SELECT item_id FROM best))"""


def _talks(spark: SparkSession, sf: str) -> DataFrame:
    turn = lambda n: F.max(F.when(F.col("turn") == n, F.col("text")))
    rows = F.sort_array(F.collect_list(F.struct("turn", "text")))
    t = _T(spark, sf, "conversations").groupBy(F.col("conv_id").alias("item_id")).agg(rows.alias("r"), turn(0).alias("query_text"), turn(1).alias("answer_text"), turn(2).alias("h"))
    text = F.array_join(F.transform("r", lambda x: x["text"]), "\n\n")
    return t.select("item_id", text.alias("display_text"), "query_text", "answer_text", F.when(F.col("h").isNotNull(), F.array("h")).alias("evidence_texts"))


@register("review_windows", f"{_WINDOWS} SELECT item_id, window_id, start_offset, end_offset, md5(window_text) AS text_md5, score FROM shown")
def review_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of every conversation for its first question."""
    shown = review.windows(_talks(spark, sf))
    return shown.select("item_id", "window_id", "start_offset", "end_offset", F.md5("window_text").alias("text_md5"), "score")


@register("review_spans", f"{_WINDOWS}, quotes AS (SELECT t.item_id, window_id, start_offset, window_text, {_STRIP.format('a')} AS quote FROM talks t JOIN shown s ON s.item_id = t.item_id WHERE a <> '') SELECT DISTINCT item_id, (start_offset + instr(window_text, quote) - 1)::INT AS start_offset, (start_offset + instr(window_text, quote) - 1 + length(quote))::INT AS end_offset FROM quotes WHERE quote <> '' AND contains(window_text, quote)")
def review_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Where the answers stand that a reviewer quotes from the windows."""
    items = _talks(spark, sf)
    shown = review.windows(items)
    quotes = shown.select("item_id", "window_id").join(items.select("item_id", F.col("answer_text").alias("quote")), "item_id")
    return review.quoted_spans(shown, quotes)


_ASKED = "SELECT conv_id, turn, text AS q, CASE conv_id % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'NO ' WHEN 2 THEN ' ' WHEN 3 THEN NULL ELSE text END AS a FROM conversations"


@register("review_candidates", f"SELECT conv_id, turn FROM ({_ASKED}) WHERE trim(q) <> '' AND trim(coalesce(a, '')) <> '' AND lower(trim(a)) NOT IN ('yes', 'no')")
def review_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Items with a question and an answer other than yes or no."""
    k = F.col("conv_id") % 5
    a = F.when(k == 0, " Yes").when(k == 1, "NO ").when(k == 2, " ").when(k == 4, F.col("text"))
    return _T(spark, sf, "conversations").where(review.reviewable(F.col("text"), a)).select("conv_id", "turn")


_EDITS = "SELECT user_id AS item_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'miss' ELSE 'add' END AS op, user_id AS document_id, ((event_id % 3) * 60)::INT AS s, ((event_id % 3) * 60 + 55)::INT AS e, (event_id % 4)::INT AS grade FROM events"


@register(
    "span_edits",
    adapters.sql(
        "SELECT item_id, document_id, s AS start_offset, e AS end_offset, arg_max(grade, seq) AS grade, false AS is_miss FROM kept GROUP BY ALL UNION ALL SELECT DISTINCT item_id, NULL, 0, 0, NULL, true FROM edits WHERE op = 'miss' AND item_id NOT IN (SELECT item_id FROM kept)",
        f"edits AS ({_EDITS}), kept AS (SELECT e.* FROM edits e JOIN docs d ON d.document_id = e.document_id WHERE op = 'add' AND d.status = 'ready' AND length(display_text) > 0 AND e <= length(display_text) AND seq > coalesce((SELECT max(m.seq) FROM edits m WHERE m.item_id = e.item_id AND m.op = 'miss'), -1))",
    ),
)
def span_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Gold spans after the edits that the events stand for."""
    start = (F.col("event_id") % 3 * 60).cast("int")
    edits = _T(spark, sf, "events").select(
        F.col("user_id").alias("item_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "miss").otherwise("add").alias("op"),
        F.col("user_id").alias("document_id"),
        start.alias("start_offset"),
        (start + 55).alias("end_offset"),
        (F.col("event_id") % 4).cast("int").alias("grade"),
    )
    return datasets.replayed_spans(edits, adapters.documents(spark, sf))


@register(
    "scope_validation",
    adapters.sql(
        """SELECT b.item_id, CASE WHEN b.item_id % 5 = 0 THEN 'routing' WHEN r.errors IS NULL THEN 'validated' ELSE 'invalid' END AS status, coalesce(r.resolved, '') AS resolved, coalesce(r.errors, '') AS errors
        FROM benchmark b LEFT JOIN (SELECT item_id, string_agg(CASE WHEN r IS NOT NULL AND p = first THEN r::VARCHAR END, ',' ORDER BY p) AS resolved, string_agg(CASE WHEN r IS NULL THEN CASE WHEN nm IS NULL THEN 'invalid_document_id:' || d ELSE 'invalid_document_file_name:' || nm END END, ',' ORDER BY p) AS errors
        FROM (SELECT *, min(p) OVER (PARTITION BY item_id, r) AS first FROM found) GROUP BY item_id) r USING (item_id)""",
        """asked AS (SELECT item_id, unnest([0, 1]) AS p, unnest([item_id, item_id + 17]) AS d, NULL::VARCHAR AS nm FROM benchmark WHERE item_id % 5 <> 0
        UNION ALL SELECT item_id, 2, NULL, 'en-' || item_id || '.md' FROM benchmark WHERE item_id % 5 IN (1, 2)),
        found AS (SELECT a.*, coalesce(x.document_id, y.document_id) AS r FROM asked a LEFT JOIN docs x ON x.document_id = a.d AND x.status = 'ready' LEFT JOIN docs y ON y.file_name = a.nm AND y.status = 'ready')""",
    ),
)
def scope_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Scopes of items that name documents by id and by file name."""
    i = F.col("item_id")
    names = F.when((i % 5).isin(1, 2), F.array(F.concat(F.lit("en-"), i.cast("string"), F.lit(".md")))).otherwise(F.array().cast("array<string>"))
    items = _T(spark, sf, "benchmark").select("item_id", F.when(i % 5 == 0, "routing").otherwise("explicit").alias("mode"), F.array(i, i + 17).alias("document_ids"), names.alias("file_names"))
    v = datasets.validated_scopes(items, adapters.documents(spark, sf))
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return v.select("item_id", "status", joined("resolved"), joined("errors"))


@register("partial_items", "SELECT doc_id, NOT (quality = 1 AND toxic = 0) AS partial FROM labels")
def partial_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose main metric (by parity of the id a summary's or a comparison's) or overall score is not scored."""
    task = F.when(F.col("doc_id") % 2 == 0, "document_summary").otherwise("cross_document_compare")
    main = F.when(F.col("doc_id") % 2 == 0, datasets.SUMMARY_METRIC).otherwise(datasets.COMPARE_METRIC)
    state = lambda good: F.when(good, "scored").otherwise("failed")
    statuses = F.create_map(main, state(F.col("quality") == 1), F.lit(datasets.OVERALL_METRIC), state(F.col("toxic") == 0))
    return _T(spark, sf, "labels").select("doc_id", datasets.partial_item(task, statuses).alias("partial"))


_CITED = "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN turn::INT END AS context_index, CASE turn % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'K' || turn END AS context_label, conv_id AS document_id, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS document_name, CASE WHEN turn % 2 = 1 THEN '  ' || role END AS heading, text AS excerpt FROM conversations"


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn")
    return _T(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.when(t % 2 == 0, t.cast("int")).alias("context_index"),
        F.when(t % 3 == 0, " ").when(t % 3 == 1, F.concat(F.lit("K"), t.cast("string"))).alias("context_label"),
        F.col("conv_id").alias("document_id"),
        F.when(t % 2 == 0, F.col("role")).otherwise("").alias("document_name"),
        F.when(t % 2 == 1, F.concat(F.lit("  "), "role")).alias("heading"),
        F.col("text").alias("excerpt"),
        *[F.lit(None).cast(k).alias(n) for n, k in (("structure_kind", "string"), ("start_offset", "int"), ("end_offset", "int"), ("source", "string"), ("truncated", "boolean"))],
    )


@register("complete_citations", f"SELECT conv_id, turn, coalesce(context_index, 0) AS context_index, CASE WHEN trim(coalesce(context_label, '')) <> '' THEN context_label ELSE 'C' || (coalesce(context_index, 0) + 1) END AS context_label, document_id::VARCHAR AS document_id, document_name, trim(heading) AS heading, md5(excerpt) AS excerpt_md5, 'text' AS structure_kind, 0 AS start_offset, 0 AS end_offset, 'benchmark' AS source, false AS truncated FROM ({_CITED})")
def complete_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Citations whose missing fields get their defaults."""
    return datasets.complete_citations(_cited(spark, sf)).withColumn("excerpt_md5", F.md5("excerpt")).drop("excerpt")


@register("cited_names", f"WITH told AS (SELECT document_id, arg_max(document_name, turn) FILTER (document_name <> '') AS told FROM ({_CITED}) GROUP BY 1) SELECT t.document_id, coalesce(d.lang || '-' || d.doc_id || '.md', told) AS document_name FROM told t LEFT JOIN (SELECT * FROM documents WHERE lang <> 'en') d ON d.doc_id = t.document_id WHERE coalesce(d.lang, told) IS NOT NULL")
def cited_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of cited documents: from the table of documents (not the English ones), else from the last citation."""
    citations = _cited(spark, sf).withColumnRenamed("turn", "place")
    return datasets.cited_names(citations, adapters.documents(spark, sf).where("lang <> 'en'"))


@register("marked_documents", "SELECT conv_id, string_agg(turn, ',' ORDER BY turn) AS turns FROM (SELECT *, row_number() OVER w - 1 AS i, bool_or(turn % 4 = 3) OVER (PARTITION BY conv_id) OR conv_id % 3 = 0 AS any_marked FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE CASE WHEN any_marked THEN turn % 4 = 3 OR (conv_id % 3 = 0 AND i = 0) ELSE i < 3 END GROUP BY conv_id")
def marked_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation as its documents: each fourth is marked, the first is named by every third conversation."""
    rows = F.sort_array(F.collect_list(F.struct("turn", (F.col("turn") % 4 == 3).alias("is_selected"))))
    talks = _T(spark, sf, "conversations").groupBy("conv_id").agg(rows.alias("d"))
    named = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit(0), F.lit(10_000)))
    kept = F.transform(prepare.marked_documents(F.col("d"), named), lambda x: x["turn"].cast("string"))
    return talks.select("conv_id", F.array_join(kept, ",").alias("turns"))


_LATIN = "'[A-Za-z0-9][A-Za-z0-9._:/+%-]*'"


@register(
    "segmented_text",
    f"""SELECT doc_id, md5(coalesce(string_agg(CASE WHEN regexp_full_match(w, {_LATIN}) AND regexp_full_match(p, {_LATIN}) THEN ' ' || w ELSE w END, '' ORDER BY i), '')) AS spaced
    FROM documents LEFT JOIN (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS i
    FROM (SELECT doc_id, regexp_split_to_array(text, '[ \n]') AS l FROM documents)) WHERE w <> '') USING (doc_id) GROUP BY doc_id""",
)
def segmented_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's words, put together as segmented tokens."""
    return _T(spark, sf, "documents").select("doc_id", F.md5(prepare.segmented_text(F.split("text", "[ \n]"))).alias("spaced"))


@register("table_question_rows", "SELECT 'fin' AS subset, doc_id::VARCHAR AS document_id, source || '.pdf' AS source_file, doc_id AS item_index, lang AS question, source AS answer, md5(trim(regexp_replace(text, '[ \\n\\t\\r]+', ' ', 'g')) || CASE WHEN lang = trim(regexp_replace(text, '[ \\n\\t\\r]+', ' ', 'g')) THEN '' ELSE chr(10) || lang END) AS evidence_md5 FROM documents WHERE trim(text) <> ''")
def table_question_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as nested entries of a table question benchmark, flattened again."""
    entry = F.to_json(
        F.struct(
            F.struct(F.col("lang").alias("text")).alias("question"),
            F.array(F.struct(F.lit("  ").alias("answer")), F.struct(F.col("source").alias("answer"))).alias("answers"),
            F.struct(F.array("text", "text").alias("raw_evidence"), F.struct(F.col("lang").alias("value")).alias("facts")).alias("evidence"),
        )
    )
    d = _T(spark, sf, "documents").where(F.trim("text") != "")
    rows = prepare.table_question_rows(d.select(F.lit("fin").alias("subset"), F.col("doc_id").alias("document_id"), F.concat("source", F.lit(".pdf")).alias("source_file"), F.col("doc_id").alias("item_index"), entry.alias("entry")))
    return rows.withColumn("evidence_md5", F.md5("evidence")).drop("evidence")


_FIRST = "(SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM documents ORDER BY doc_id LIMIT 10)"
_CLAIMS = "array_to_string(CASE WHEN len({l}) > 0 THEN list_transform({l}[1:2], lambda x: substr(x, 1, 120)) ELSE [substr({t}, 1, 120)] END, '|')"
_SENTENCES = r"list_filter(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: y <> '')"
_PARTS = "list_filter(list_transform(regexp_split_to_array({}, '{}'), lambda x: " + _STRIP.format("x") + "), lambda x: x <> '')"


@register(
    "package_articles",
    f"SELECT i::INT AS item_index, 'lcsts-summary-' || i AS id, 'lcsts-article-' || lpad(i::VARCHAR, 2, '0') || '.md' AS names, substr(h[1], 1, 240) AS quotes, {_CLAIMS.format(l='h', t='text')} AS claims, md5(text) AS answer_md5 FROM (SELECT *, {_PARTS.format('text', '[。！？]')} AS h FROM {_FIRST})",
)
def package_articles(spark: SparkSession, sf: str) -> DataFrame:
    """The first documents, behind the instruction, as articles of a summary package."""
    d = _T(spark, sf, "documents").select("doc_id", F.concat(F.lit(packages.INSTRUCTION), "text").alias("article"), F.col("text").alias("summary"))
    return _package(packages.article_items(d, ["doc_id"]))


def _package(items: DataFrame) -> DataFrame:
    return items.select(
        "item_index",
        "id",
        F.array_join("expected_document_names", "|").alias("names"),
        F.array_join(F.transform("gold_span_refs", lambda q: q["quote"]), "|").alias("quotes"),
        F.array_join("required_claims_or_axes", "|").alias("claims"),
        F.md5("reference_answer").alias("answer_md5"),
    )


@register(
    "package_reports",
    f"""SELECT i::INT AS item_index, 'multinews-summary-' || i AS id, array_to_string(list_transform(range(1, least(len(p), 3) + 1), lambda k: 'multinews-' || lpad(i::VARCHAR, 2, '0') || '-doc-' || k || '.md'), '|') AS names,
    array_to_string(list_transform(p[1:3], lambda x: substr({_SENTENCES.format('x')}[1], 1, 240)), '|') AS quotes, {_CLAIMS.format(l=_SENTENCES.format('t'), t='t')} AS claims, md5(t) AS answer_md5
    FROM (SELECT i, {_STRIP.format('text')} AS t, list_filter(list_transform(string_split(text || '|||||' || source || '|||||  |||||' || lang || '|||||x', '|||||'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS p FROM {_FIRST})""",
)
def package_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The first documents as lines of several reports."""
    line = F.concat_ws(packages.PARTED, F.replace(F.col("text"), F.lit("\n"), F.lit(packages.LINE_END)), "source", F.lit("  "), "lang", F.lit("x"))
    return _package(packages.report_items(_T(spark, sf, "documents").select("doc_id", line.alias("source"), F.col("text").alias("summary")), ["doc_id"]))


@register(
    "run_report",
    """SELECT '# Summary / Compare Benchmark' || chr(10) || chr(10) || '- Benchmark: `pilot` `1.0`' || chr(10) || '- Dataset Count: `' || count(*) || '`' || chr(10) || '- Item Count: `' || sum(n) || '`' || chr(10) || '- Summary Benchmark Score: `scored`' || chr(10)
    || '- Compare Benchmark Score: `not_applicable`' || chr(10) || '- Parallel Workers: `1`' || chr(10) || '- Judge Failed Count: `0`' || chr(10) || '- Partial Item Count: `' || sum(bad) || '`' || chr(10) || chr(10) || '## Per Dataset Scores' || chr(10) || chr(10)
    || string_agg('- `' || source || '`: metric=`bert_score_f1` value=`' || CASE WHEN n % 2 = 0 THEN n::VARCHAR ELSE 'judge_failed' END || '` partial=`' || CASE WHEN bad > 0 THEN 'True' ELSE 'False' END || '`', chr(10) ORDER BY source) || chr(10) || chr(10) || '## Baseline Delta' || chr(10) || chr(10) || '```json' || chr(10) || '{}' || chr(10) || '```' AS report
    FROM (SELECT source, count(*) AS n, count(*) FILTER (quality = 0) AS bad FROM documents JOIN labels USING (doc_id) GROUP BY source)""",
)
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    """Report of a run whose datasets are the sources of the labelled documents."""
    d = _T(spark, sf, "documents").select("doc_id", "source").join(_T(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    n = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("quality") == 0, 1)).alias("bad"))
    scores = n.select(F.col("source").alias("dataset"), F.lit(datasets.SUMMARY_METRIC).alias("metric"), F.when(F.col("n") % 2 == 0, F.col("n")).alias("value"), F.lit("judge_failed").alias("status"), (F.col("bad") > 0).alias("partial"))
    constants = {"name": "pilot", "version": "1.0", "workers": 1, "judge_failed": 0, "summary_score": "scored", "compare_score": "not_applicable", "deltas": "{}"}
    run = n.agg(F.sum("n").alias("items"), F.sum("bad").alias("partial_items")).select("*", *[F.lit(v).alias(k) for k, v in constants.items()])
    return packages.run_report(run, scores)
