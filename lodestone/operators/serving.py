"""What goes to a client or a report: citations, planning signals, synopses, answers, packets, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import optional, squeeze
from .recall import ranked

# Phrases by which an answer says that evidence is missing: of the checkpoint, and of the runtime (fixed values, two lists).
CHECKPOINT_INSUFFICIENT = ["證據不足", "資訊不足", "無法確認", "需要回看", "insufficient evidence", "not enough evidence", "cannot confirm", "need to verify"]
RUNTIME_INSUFFICIENT = ["證據不足", "資訊不足", "無法確認", "目前引用內容仍不足", "insufficient evidence", "not enough evidence", "cannot confirm"]
#: Extensions that uploads may have (fixed values).
EXTENSIONS = [".txt", ".md", ".pdf", ".docx", ".pptx", ".html", ".xlsx"]


def says_insufficient(answer: Column, phrases: list[str] = CHECKPOINT_INSUFFICIENT) -> Column:
    return F.lower(answer).rlike("|".join(phrases))


def group_source(sources: Column) -> Column:
    """Source of a group of candidates: hybrid if any is or if they differ, else theirs, fts if there is none."""
    kinds = F.array_distinct(sources)
    return F.when(F.array_contains(kinds, "hybrid") | (F.size(kinds) > 1), "hybrid").otherwise(F.coalesce(F.try_element_at(kinds, F.lit(1)), F.lit("fts")))


def upload_error(file_name: Column, size: Column, most: int) -> Column:
    """Why an upload is refused, null if it is not."""
    known = F.lit(False)
    for e in EXTENSIONS:
        known = known | F.lower(file_name).endswith(e)
    return F.when(F.coalesce(F.trim(file_name), F.lit("")) == "", "missing_name").when(~known, "unknown_extension").when(size < 1, "empty").when(size > most, "too_large")


def page_ranges(regions: DataFrame, key: str) -> DataFrame:
    """(key, page_start, page_end, regions) of region rows (key, page, left, bottom, right, top): those with all sides count;
    a key without any has nulls. No key's regions are gathered."""
    whole = F.col("left").isNotNull() & F.col("bottom").isNotNull() & F.col("right").isNotNull() & F.col("top").isNotNull()
    page = F.when(whole, F.col("page"))
    return regions.groupBy(key).agg(F.min(page).alias("page_start"), F.max(page).alias("page_end"), F.count(F.when(whole, 1)).cast("int").alias("regions"))


def page_range(regions: Column) -> Column:
    """struct(page_start, page_end) of a list of regions."""
    pages = F.transform(regions, lambda r: r["page"])
    return F.struct(F.array_min(pages).alias("page_start"), F.array_max(pages).alias("page_end"))


def usable_regions(regions: Column) -> Column:
    """Regions with all four coordinates."""
    return F.filter(regions, lambda r: r["left"].isNotNull() & r["bottom"].isNotNull() & r["right"].isNotNull() & r["top"].isNotNull())


def coverage_signals(resolved: Column, covered: Column) -> Column:
    """struct(missing, supports_compare): resolved documents without a context; two documents support a comparison."""
    return F.struct(F.array_except(resolved, covered).alias("missing"), (F.size(F.array_distinct(covered)) >= 2).alias("supports_compare"))


def planned(ready: DataFrame, hits: DataFrame, key: str = "area_id", first: int = 5) -> DataFrame:
    """Documents to plan with, per key: those hit, or where none is the first few by id.

    Only keys without a hit are ranked, and no more than the first few rows of a task leave it: no key's rows meet in one task.
    """
    held = ready.join(hits.select("document_id").distinct(), "document_id", "left_semi")
    busy = held.select(F.col(key).alias("__busy")).distinct()
    idle = ready.join(busy, F.col(key).eqNullSafe(F.col("__busy")), "left_anti")
    return held.unionByName(ranked(idle, [key], ["document_id"], "__place", first).drop("__place"))


def prefixed(source: Column, prefix: str) -> Column:
    """Values of the lines that start with a prefix, blank ones left out."""
    lines = F.filter(F.split(source, "\n"), lambda x: x.startswith(prefix))
    return F.filter(F.transform(lines, lambda x: squeeze(F.substring(x, F.lit(len(prefix) + 1), F.length(x)))), lambda x: x != "")


def shortened(c: Column, chars: int) -> Column:
    return F.when(F.length(c) <= chars, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, chars - 1)), F.lit("…")))


def synopsis(file_name: Column, source: Column, chars: int = 1600) -> Column:
    """The four lines of the deterministic English synopsis of a document."""
    headings, tables, body = prefixed(source, "Heading:"), prefixed(source, "Table/Structure:"), prefixed(source, "Excerpt:")
    some = lambda a, n, none: F.when(F.size(a) > 0, F.array_join(F.slice(a, 1, n), "; ")).otherwise(F.lit(none))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Topic: "), shortened(squeeze(file_name), 80)),
        F.concat(F.lit("Key sections: "), some(headings, 4, "No explicit section headings were detected.")),
        F.concat(F.lit("Main conclusions: "), F.coalesce(F.try_element_at(body, F.lit(1)), F.lit("No sufficient body content was detected."))),
        F.concat(F.lit("Tables and structure: "), some(tables, 3, "No explicit table highlights were detected.")),
    )
    return shortened(lines, chars)


def first_fitting(versions: list[Column], chars: int) -> Column:
    """The first version within so many characters, else the last one cut."""
    return F.coalesce(*[F.when(F.length(v) <= chars, v) for v in versions], F.substring(versions[-1], 1, chars))


def distinct_contexts(contexts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Contexts with the same document, parent and span once, the first seen, labelled anew from C1."""
    span = ["document_id", "parent_id", "start_offset", "end_offset"]
    once = contexts.withColumn("__rn", F.row_number().over(Window.partitionBy(*by, *span).orderBy(order))).where("__rn = 1").drop("__rn")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return once.withColumn("context_label", F.concat(F.lit("C"), place.cast("string")))


def answer(question: Column, texts: Column, headings: Column) -> Column:
    """The deterministic answer: the first three distinct headings and 320 characters of the first two contexts."""
    body = F.trim(F.array_join(F.transform(F.slice(texts, 1, 2), lambda t: F.trim(F.replace(t, F.lit("\n"), F.lit(" ")))), " "))
    names = F.array_distinct(F.slice(F.filter(headings, lambda h: h.isNotNull() & (h != "")), 1, 3))
    named = F.when(F.size(names) > 0, F.array_join(names, "、")).otherwise("相關段落")
    some = F.concat(F.lit("根據目前已授權且完成索引的內容，問題「"), question, F.lit("」可參考 "), named, F.lit("。重點如下："), F.substring(body, 1, 320))
    return F.when(F.size(texts) > 0, some).otherwise("目前可用的已授權文件中沒有足夠內容可以回答這個問題。")


def merged_decisions(packets: DataFrame, decisions: DataFrame, order: str) -> DataFrame:
    """Packets with their decision (the last one wins) or seeded result, and whether one is missing."""
    w = Window.partitionBy("packet_id").orderBy(F.desc(order))
    last = decisions.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select("packet_id", "decision")
    j = packets.join(last, "packet_id", "left").withColumn("result", F.coalesce("seeded", "decision"))
    return j.withColumn("missing", F.col("result").isNull())


def resolve_span(text: Column, quote: Column, start: Column, end: Column) -> Column:
    """struct(start, end, error): explicit offsets inside the text, else the first place of the quote."""
    explicit = start.isNotNull() & end.isNotNull()
    ok = explicit & (start >= 0) & (start < end) & (end <= F.length(text))
    found = F.instr(text, quote)
    none = F.lit(None).cast("int")
    s = F.when(ok, start).when(~explicit & (found > 0), found - 1).otherwise(none).cast("int")
    e = F.when(ok, end).when(~explicit & (found > 0), found - 1 + F.length(quote)).otherwise(none).cast("int")
    error = F.when(text.isNull(), "display_text_missing").when(s.isNull(), "unresolved")
    return F.struct(s.alias("start"), e.alias("end"), error.alias("error"))


def slug(c: Column, suffix: str) -> Column:
    """A safe file name."""
    return F.concat(F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.trim(c), "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("document")), F.lit(suffix))


def stable_uuid(c: Column) -> Column:
    """The version-5 UUID of a string in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(c, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def mapped_language(c: Column) -> Column:
    return F.when(c.isin("zh_tw", "zh-TW"), "zh-TW").when(c.isin("en", "mixed"), c)


def blank_as(c: Column, default: str) -> Column:
    return F.coalesce(optional(c), F.lit(default))


def context_payload(contexts: DataFrame, documents: DataFrame) -> DataFrame:
    """Contexts as an answering tool gets them: label, document's name (empty if unknown), heading, text, source, span, children.

    documents: document_id, file_name. Contexts are few a query; how the names meet them is left to the planner, by size.
    """
    names = documents.join(contexts.select("document_id").distinct(), "document_id", "left_semi")
    rows = contexts.join(names, "document_id", "left").withColumn("document_name", F.coalesce("file_name", F.lit("")))
    return rows.select(
        "query_id", "context_index", "context_label", "document_id", "document_name", "parent_id", F.col("child_ids").alias("child_chunk_ids"), "structure_kind", "heading", F.col("context_text").alias("assembled_text"), "source", "start_offset", "end_offset", "truncated"
    )


def tool_contexts(payload: DataFrame) -> DataFrame:
    """The short form for a tool call: label, index, document's name, heading, text."""
    return payload.select("query_id", "context_label", "context_index", "document_name", "heading", "assembled_text")


#: What an answer that compares is told to do, the state and reasons that need no trace (fixed values).
COMPARE_TEMPLATE = ["先逐一說明每份文件的直接證據與立場。", "再整理共同點與差異；只有雙方都有直接證據時才能寫成共同點。", "若目前已具備雙邊直接證據，直接完成比較，不要加入 required documents 或 tool coverage 狀態前言；只有真的缺少其中一方證據時，才簡短說明證據不足。"]
QUIET, UNTOLD = "normal", ["not_started", "continue"]


def tool_payloads(contexts: DataFrame, planning: DataFrame, calls: DataFrame) -> DataFrame:
    """One row a tool call: what the answering model gets, as columns that to_json turns into its payload.

    contexts: rows of tool_contexts() with document_id; planning: query_id, place, document_id, document_name, mentioned, hit;
    calls: query_id, query_type, tool_calls, followups, inspections, latency_status, stop_reason. A call has few contexts and
    documents to plan with, by the limits that they were selected under. Without contexts the lists are empty.
    """
    shown = contexts.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("context_index", "context_label", "document_name", "heading", "assembled_text"))).alias("assembled_contexts"),
        F.collect_set("document_id").alias("covered"),
    )
    order = F.sort_array(F.collect_list(F.struct("place", "document_id", "document_name", "mentioned", "hit")))
    plans = planning.groupBy("query_id").agg(order.alias("planned"))
    rows = calls.join(shown, "query_id", "left").join(plans, "query_id", "left")
    none = lambda name, kind: F.coalesce(name, F.array().cast(kind)).alias(name)
    kinds = dict(rows.dtypes)
    rows = rows.select(*calls.columns, *[none(n, kinds[n]) for n in ("assembled_contexts", "covered", "planned")])
    part = lambda c, name: F.transform(c, lambda x: x[name])
    wanted = F.filter("planned", lambda x: x["mentioned"] | x["hit"])
    compare = F.col("query_type") == "cross_document_compare"
    contract = F.when(compare, F.struct(F.col("query_type").alias("task_type"), F.array_distinct(part(wanted, "document_name")).alias("required_document_names"), F.array(*map(F.lit, COMPARE_TEMPLATE)).alias("compare_answer_template")))
    told = (F.col("followups") > 0) | (F.col("inspections") > 0) | (F.col("latency_status") != QUIET) | ~F.col("stop_reason").isin(UNTOLD)
    trace = F.when(told, F.struct(F.col("tool_calls").alias("tool_call_count"), F.col("followups").alias("followup_call_count"), F.col("inspections").alias("synopsis_inspection_count"), F.col("latency_status").alias("latency_budget_status"), "stop_reason"))
    return rows.select(
        "query_id",
        "query_type",
        "assembled_contexts",
        coverage_signals(part(F.filter("planned", lambda x: x["mentioned"]), "document_id"), F.col("covered")).alias("coverage_signals"),
        F.transform("planned", lambda x: F.struct(x["document_name"].alias("document_name"), x["mentioned"].alias("mentioned_by_query"), x["hit"].alias("hit_in_current_round"))).alias("planning_documents"),
        trace.alias("loop_trace_delta"),
        contract.alias("response_contract"),
    )


def tool_summary(payloads: DataFrame, citations: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row a tool call for its event: counts of contexts and citations, the routing decision, coverage and contract.

    citations: query_id, one row each; decisions: query_id, label, source, confidence, fallback_used, fallback_reason.
    """
    cited = citations.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("citations_count"))
    routed = decisions.select("query_id", F.col("source").alias("query_type_source"), F.col("confidence").alias("query_type_confidence"), F.col("fallback_used").alias("query_type_fallback_used"), F.col("fallback_reason").alias("query_type_fallback_reason"))
    rows = payloads.join(cited, "query_id", "left").join(routed, "query_id", "left").fillna(0, ["citations_count"])
    return rows.select("query_id", F.size("assembled_contexts").alias("contexts_count"), "citations_count", "query_type", *routed.columns[1:], "coverage_signals", "planning_documents", F.col("response_contract").isNotNull().alias("has_contract"))


def citations(payload: DataFrame) -> DataFrame:
    """Citations of context_payload() rows: label, document, span, and the text as excerpt."""
    return payload.select("query_id", "context_index", "context_label", "document_id", "document_name", "parent_id", "child_chunk_ids", "heading", "structure_kind", "start_offset", "end_offset", F.col("assembled_text").alias("excerpt"), "source", "truncated")
