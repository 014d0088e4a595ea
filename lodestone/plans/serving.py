"""Queries over citations, planning signals, synopses, answers, packets and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, recall, serving
from ..sources import adapters
from .catalog import register

_T = adapters.table


def _sql_any(expr: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({expr}), '{p}')" for p in phrases) + ")"


_ANSWERS = "(SELECT *, text || CASE conv_id % 4 WHEN 0 THEN ' Insufficient evidence.' WHEN 1 THEN ' 需要回看' WHEN 2 THEN ' need to verify' ELSE '' END AS a FROM conversations)"


@register("insufficient_evidence", f"SELECT count(*) FILTER ({_sql_any('a', serving.CHECKPOINT_INSUFFICIENT)}) AS checkpoint, count(*) FILTER ({_sql_any('a', serving.RUNTIME_INSUFFICIENT)}) AS runtime FROM {_ANSWERS}")
def insufficient_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that say evidence is missing, by the two phrase lists."""
    tail = F.when(F.col("conv_id") % 4 == 0, " Insufficient evidence.").when(F.col("conv_id") % 4 == 1, " 需要回看").when(F.col("conv_id") % 4 == 2, " need to verify").otherwise("")
    a = _T(spark, sf, "conversations").select(F.concat("text", tail).alias("a"))
    return a.agg(F.count(F.when(serving.says_insufficient(F.col("a")), 1)).alias("checkpoint"), F.count(F.when(serving.says_insufficient(F.col("a"), serving.RUNTIME_INSUFFICIENT), 1)).alias("runtime"))


@register("context_source", "SELECT user_id, CASE WHEN list_contains(s, 'hybrid') OR len(list_distinct(s)) > 1 THEN 'hybrid' ELSE coalesce(s[1], 'fts') END AS source FROM (SELECT user_id, list(CASE event_type WHEN 'view' THEN 'vector' WHEN 'error' THEN 'hybrid' ELSE 'fts' END) AS s FROM events GROUP BY ALL)")
def context_source(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "vector").when(F.col("event_type") == "error", "hybrid").otherwise("fts")
    g = _T(spark, sf, "events").groupBy("user_id").agg(F.collect_set(kind).alias("s"))  # three kinds at most
    return g.select("user_id", serving.group_source(F.col("s")).alias("source"))


@register("upload_validation", "SELECT error, count(*) AS n FROM (SELECT CASE WHEN trim(f) = '' THEN 'missing_name' WHEN NOT regexp_matches(lower(f), '\\.(txt|md|pdf|docx|pptx|html|xlsx)$') THEN 'unknown_extension' WHEN n_chars < 1 THEN 'empty' WHEN n_chars > 3000 THEN 'too_large' END AS error FROM (SELECT n_chars, CASE doc_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN doc_id || '.TXT' WHEN 2 THEN doc_id || '.exe' ELSE doc_id || '.md' END AS f FROM documents)) GROUP BY ALL")
def upload_validation(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 5 == 0, " ").when(F.col("doc_id") % 5 == 1, F.concat("doc_id", F.lit(".TXT"))).when(F.col("doc_id") % 5 == 2, F.concat("doc_id", F.lit(".exe"))).otherwise(F.concat("doc_id", F.lit(".md")))
    return _T(spark, sf, "documents").groupBy(serving.upload_error(name, F.col("n_chars"), 3000).alias("error")).agg(F.count(F.lit(1)).alias("n"))


_REGIONS = "(SELECT user_id, list({page: (event_id % 9)::INT, l: CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END}) AS r FROM events GROUP BY ALL)"


@register("page_ranges", f"SELECT user_id, list_min(list_transform(u, lambda x: x.page)) AS page_start, list_max(list_transform(u, lambda x: x.page)) AS page_end, len(u)::INT AS regions FROM (SELECT user_id, list_filter(r, lambda x: x.l IS NOT NULL) AS u FROM {_REGIONS})")
def page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Page span of the regions whose boxes are whole."""
    sides = [F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("left"), *[F.col("value").alias(x) for x in ("bottom", "right", "top")]]
    return serving.page_ranges(_T(spark, sf, "events").select("user_id", (F.col("event_id") % 9).cast("int").alias("page"), *sides), "user_id")


@register("coverage_signals", "SELECT conv_id, len(list_filter(list_distinct(e), lambda x: NOT list_contains(f, x)))::INT AS missing, len(list_distinct(f)) >= 2 AS supports_compare FROM (SELECT conv_id, list(turn % 5) AS e, coalesce(list(turn % 5) FILTER (turn % 2 = 0), []) AS f FROM conversations GROUP BY ALL)")
def coverage_signals(spark: SparkSession, sf: str) -> DataFrame:
    g = _T(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set(F.col("turn") % 5).alias("e"), F.collect_set(F.when(F.col("turn") % 2 == 0, F.col("turn") % 5)).alias("f"))
    return g.select("conv_id", serving.coverage_signals(F.col("e"), F.col("f")).alias("s")).select("conv_id", F.size("s.missing").alias("missing"), "s.supports_compare")


@register("planning_documents", adapters.sql("SELECT area_id, document_id FROM (SELECT d.area_id, d.document_id, h.document_id IS NOT NULL AS hit, bool_or(h.document_id IS NOT NULL) OVER (PARTITION BY d.area_id) AS any_hit, row_number() OVER (PARTITION BY d.area_id ORDER BY d.document_id) AS place FROM docs d LEFT JOIN (SELECT DISTINCT document_id FROM gold) h USING (document_id) WHERE d.status = 'ready') WHERE hit OR (NOT any_hit AND place <= 5)"))
def planning_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Per area the documents with gold evidence, else the first five."""
    docs = adapters.documents(spark, sf)
    ready = docs.where("status = 'ready'").select("area_id", "document_id")
    return serving.planned(ready, adapters.gold_spans(docs, spark, sf)).select("area_id", "document_id")


@register("document_synopsis", adapters.sql(f"""SELECT document_id, CASE WHEN length(s) <= 1600 THEN s ELSE rtrim(substr(s, 1, 1599)) || '…' END AS synopsis FROM (SELECT document_id, 'Topic: ' || file_name || chr(10) || 'Key sections: ' || coalesce(nullif(trim(regexp_replace(split_part(src, chr(10), 1)[9:], '\\s+', ' ', 'g')), ''), 'No explicit section headings were detected.')
 || chr(10) || 'Main conclusions: ' || coalesce(nullif(trim(regexp_replace(list_filter(string_split(src, chr(10)), lambda x: starts_with(x, 'Excerpt:'))[1][9:], '\\s+', ' ', 'g')), ''), 'No sufficient body content was detected.')
 || chr(10) || 'Tables and structure: ' || CASE WHEN contains(display_text, ' | ') THEN 'rows' ELSE 'No explicit table highlights were detected.' END AS s FROM (SELECT *, 'Heading: ' || replace(heading, chr(10), ' ') || chr(10) || 'Excerpt: ' || replace(display_text, chr(10), ' ') || chr(10) || CASE WHEN contains(display_text, ' | ') THEN 'Table/Structure: rows' ELSE 'Excerpt:' END AS src FROM docs))"""))
def document_synopsis(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic synopses from heading, the whole text as its excerpt, and structure lines."""
    flat = lambda c: F.replace(c, F.lit("\n"), F.lit(" "))
    d = adapters.documents(spark, sf)
    src = F.concat(F.lit("Heading: "), flat(F.col("heading")), F.lit("\nExcerpt: "), flat(F.col("display_text")), F.when(F.contains("display_text", F.lit(" | ")), "\nTable/Structure: rows").otherwise("\nExcerpt:"))
    return d.select("document_id", serving.synopsis(F.col("file_name"), src).alias("synopsis"))


@register("synopsis_budget", adapters.sql("SELECT document_id, length(CASE WHEN length(display_text) <= 2000 THEN display_text WHEN length(substr(display_text, 1, length(display_text) // 2)) <= 2000 THEN substr(display_text, 1, length(display_text) // 2) WHEN length(substr(display_text, 1, length(display_text) // 4)) <= 2000 THEN substr(display_text, 1, length(display_text) // 4) ELSE substr(display_text, 1, 2000) END) AS n FROM docs"))
def synopsis_budget(spark: SparkSession, sf: str) -> DataFrame:
    """The first of shrinking versions that fits a budget, else a cut."""
    d = adapters.documents(spark, sf)
    part = lambda k: F.substring("display_text", F.lit(1), F.floor(F.length("display_text") / k).cast("int"))
    versions = [F.col("display_text"), part(2), part(4)]
    fit = F.coalesce(*[F.when(F.length(v) <= 2000, v) for v in versions], F.substring("display_text", 1, 2000))
    return d.select("document_id", F.length(fit).cast("long").alias("n"))


@register("distinct_contexts", "SELECT user_id, event_id, 'C' || row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS context_label FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1)")
def distinct_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts of a session seen twice are one, labels start anew."""
    e = _T(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("document_id"), F.lit(0).alias("parent_id"), F.lit(0).alias("start_offset"), F.lit(1).alias("end_offset"))
    return serving.distinct_contexts(e, ["user_id"], "event_id").select("user_id", "event_id", "context_label")


@register("deterministic_answer", "SELECT conv_id, '根據目前已授權且完成索引的內容，問題「' || q || '」可參考 ' || CASE WHEN len(h) > 0 THEN h[1] ELSE '相關段落' END || '。重點如下：' || substr(trim(array_to_string(list_transform(t[1:2], lambda x: trim(replace(x, chr(10), ' '))), ' ')), 1, 320) AS answer FROM (SELECT conv_id, arg_min(text, turn) AS q, list(text ORDER BY turn) AS t, list_distinct(list(role)[1:1]) AS h FROM conversations GROUP BY ALL)".replace("list_distinct(list(role)[1:1])", "list(role ORDER BY turn)[1:1]"))
def deterministic_answer(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct("turn", "text", "role")
    g = _T(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("l"))
    texts, heads = F.transform("l", lambda x: x["text"]), F.slice(F.transform("l", lambda x: x["role"]), 1, 1)
    return g.select("conv_id", serving.answer(F.element_at("l", 1)["text"], texts, heads).alias("answer"))


@register("offline_packets", "SELECT p.doc_id AS packet_id, coalesce(CASE WHEN p.doc_id % 6 = 0 THEN 'seeded' END, d.decision) AS result, coalesce(CASE WHEN p.doc_id % 6 = 0 THEN 'seeded' END, d.decision) IS NULL AS missing FROM labels p LEFT JOIN (SELECT user_id, event_type AS decision FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) d ON d.user_id = p.doc_id")
def offline_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Judge packets with the last decision on each, seeded results first, missing ones flagged."""
    p = _T(spark, sf, "labels").select(F.col("doc_id").alias("packet_id"), F.when(F.col("doc_id") % 6 == 0, "seeded").alias("seeded"))
    d = _T(spark, sf, "events").select(F.col("user_id").alias("packet_id"), F.col("event_type").alias("decision"), "event_id")
    return serving.merged_decisions(p, d, "event_id").select("packet_id", "result", "missing")


@register("gold_references", adapters.sql("SELECT d.document_id, CASE WHEN d.document_id % 3 = 0 THEN CASE WHEN 5 < length(d.display_text) + 1 AND d.document_id % 2 = 0 THEN 0 END WHEN instr(d.display_text, q) > 0 THEN instr(d.display_text, q) - 1 END::INT AS start_offset, CASE WHEN d.document_id % 3 = 0 THEN CASE WHEN 5 < length(d.display_text) + 1 AND d.document_id % 2 = 0 THEN 5 END WHEN instr(d.display_text, q) > 0 THEN instr(d.display_text, q) - 1 + length(q) END::INT AS end_offset FROM (SELECT *, CASE WHEN document_id % 5 = 0 THEN 'no such quote' ELSE substr(display_text, 11, 15) END AS q FROM docs) d"))
def gold_references(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence given by offsets or by a quote, resolved against the text."""
    quote = F.when(F.col("document_id") % 5 == 0, "no such quote").otherwise(F.substring("display_text", 11, 15))
    explicit = F.col("document_id") % 3 == 0
    start = F.when(explicit, 0)
    end = F.when(explicit, F.when(F.col("document_id") % 2 == 0, 5).otherwise(100_000_000))
    r = adapters.documents(spark, sf).select("document_id", serving.resolve_span(F.col("display_text"), quote, start, end).alias("r"))
    return r.select("document_id", F.col("r.start").alias("start_offset"), F.col("r.end").alias("end_offset"))


@register("citation_readiness", adapters.sql("SELECT g.query_id, g.document_id FROM (SELECT DISTINCT query_id, document_id + 1 AS document_id FROM gold) g WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.document_id = g.document_id AND d.status = 'ready')"))
def citation_readiness(spark: SparkSession, sf: str) -> DataFrame:
    """Citations whose document is not ready."""
    docs = adapters.documents(spark, sf)
    cited = adapters.gold_spans(docs, spark, sf).select("query_id", (F.col("document_id") + 1).alias("document_id")).distinct()
    return cited.join(docs.where("status = 'ready'").select("document_id"), "document_id", "left_anti").select("query_id", "document_id")


@register("slugs", "SELECT page_id, coalesce(nullif(trim(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '-', 'g'), '-'), ''), 'document') || '.md' AS slug FROM pages")
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return _T(spark, sf, "pages").select("page_id", serving.slug(F.col("url"), ".md").alias("slug"))


@register("snapshot_export", adapters.sql("SELECT g.query_id, g.document_id, d.file_name, sha256(substr(d.display_text, g.start_offset + 1, g.end_offset - g.start_offset)) AS span_sha256, d.lang AS language FROM gold g JOIN docs d USING (document_id)"))
def snapshot_export(spark: SparkSession, sf: str) -> DataFrame:
    """Gold spans as exported: file name, digest of the span's text, language."""
    docs = adapters.documents(spark, sf)
    j = adapters.gold_spans(docs, spark, sf).join(docs, "document_id")
    cut = F.substring("display_text", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    return j.select("query_id", "document_id", "file_name", F.sha2(cut, 256).alias("span_sha256"), F.col("lang").alias("language"))


@register("snapshot_import_checks", adapters.sql("SELECT CASE WHEN d.document_id IS NULL THEN 'missing_document' WHEN g.end_offset > length(d.display_text) THEN 'span_out_of_range' ELSE 'ok' END AS outcome, count(*) AS n FROM (SELECT query_id, document_id + query_id % 3 AS document_id, end_offset FROM gold) g LEFT JOIN (SELECT * FROM docs WHERE status = 'ready') d USING (document_id) GROUP BY ALL"))
def snapshot_import_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Imported spans against the ready documents at hand."""
    docs = adapters.documents(spark, sf)
    g = adapters.gold_spans(docs, spark, sf).select("query_id", (F.col("document_id") + F.col("query_id") % 3).alias("document_id"), "end_offset")
    ready = docs.where("status = 'ready'").select("document_id", F.length("display_text").alias("n_text"))
    out = F.when(F.col("n_text").isNull(), "missing_document").when(F.col("end_offset") > F.col("n_text"), "span_out_of_range").otherwise("ok")
    return g.join(ready, "document_id", "left").groupBy(out.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@register("source_choice", "SELECT lang, arg_min(f, (p, f)) AS file FROM (SELECT lang, lang || '-' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.pdf' ELSE '.html' END AS f, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS p FROM documents) GROUP BY ALL")
def source_choice(spark: SparkSession, sf: str) -> DataFrame:
    """One source file per key, by priority of the extension, then by path."""
    ext = F.element_at(F.array(F.lit(".txt"), F.lit(".pdf"), F.lit(".html")), (F.col("doc_id") % 3 + 1).cast("int"))
    p = F.when(ext == ".pdf", 0).when(ext == ".html", 1).otherwise(2)
    d = _T(spark, sf, "documents").select("lang", F.concat("lang", F.lit("-"), "doc_id", ext).alias("f"), p.alias("p"))
    return d.groupBy("lang").agg(F.min_by("f", F.struct("p", "f")).alias("file"))


@register("config_snapshot", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'gold' ELSE 'routing' END AS scope, (10 + item_id % 3)::INT AS top_k FROM benchmark")
def config_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Run settings written as JSON and read back; a missing scope is routing."""
    scope = F.when(F.col("item_id") % 2 == 0, "gold")
    b = _T(spark, sf, "benchmark").select("item_id", F.to_json(F.struct((10 + F.col("item_id") % 3).alias("top_k"), scope.alias("scope"))).alias("j"))
    return b.select("item_id", F.coalesce(F.get_json_object("j", "$.scope"), F.lit("routing")).alias("scope"), F.get_json_object("j", "$.top_k").cast("int").alias("top_k"))


@register("language_values", "SELECT language, count(*) AS n FROM (SELECT CASE WHEN v IN ('zh_tw', 'zh-TW') THEN 'zh-TW' WHEN v IN ('en', 'mixed') THEN v END AS language FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'zh_tw' WHEN 1 THEN 'zh-TW' WHEN 2 THEN 'mixed' WHEN 3 THEN 'xx' ELSE lang END AS v FROM documents)) GROUP BY ALL")
def language_values(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("doc_id") % 5 == 0, "zh_tw").when(F.col("doc_id") % 5 == 1, "zh-TW").when(F.col("doc_id") % 5 == 2, "mixed").when(F.col("doc_id") % 5 == 3, "xx").otherwise(F.col("lang"))
    return _T(spark, sf, "documents").groupBy(serving.mapped_language(v).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@register("dataset_summary", "SELECT source, count(l.doc_id) AS labelled, count(*) AS documents, round(count(l.doc_id) / count(*), 6) AS share FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL")
def dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    j = _T(spark, sf, "documents").join(_T(spark, sf, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    return j.groupBy("source").agg(F.count("l").alias("labelled"), F.count(F.lit(1)).alias("documents"), F.round(F.count("l") / F.count(F.lit(1)), 6).alias("share"))


@register("first_hit_ranks", adapters.sql("SELECT g.query_id, min(c.place) AS first_hit_rank FROM gold g LEFT JOIN (SELECT document_id, start_offset, end_offset, row_number() OVER (PARTITION BY document_id ORDER BY position) AS place FROM children) c ON c.document_id = g.document_id AND c.start_offset < g.end_offset AND g.start_offset < c.end_offset GROUP BY ALL"))
def first_hit_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Place of the first chunk of a gold document that overlaps the evidence."""
    docs = adapters.documents(spark, sf)
    kids = recall.ranked(adapters.children(docs), ["document_id"], ["position"], "place")
    on = (F.col("g.document_id") == F.col("c.document_id")) & metrics.overlaps("c", "g")
    return adapters.gold_spans(docs, spark, sf).alias("g").join(kids.alias("c"), on, "left").groupBy("query_id").agg(F.min("c.place").alias("first_hit_rank"))


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@register("stable_uuids", f"SELECT page_id, {_UUID} AS uuid FROM (SELECT page_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)")
def stable_uuids(spark: SparkSession, sf: str) -> DataFrame:
    """Version-5 UUIDs of page addresses; tested against Python's."""
    return _T(spark, sf, "pages").select("page_id", serving.stable_uuid(F.col("url")).alias("uuid"))
