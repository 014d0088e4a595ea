"""Evaluation datasets: edits of gold spans, scopes of items, defaults of citations, names of cited documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Main metric of a task type, and the score that every item needs (fixed values).
SUMMARY_METRIC, COMPARE_METRIC, OVERALL_METRIC = "bert_score_f1", "pairwise_rubric_judge_win_rate", "avg_overall_score"


def replayed_spans(edits: DataFrame, documents: DataFrame) -> DataFrame:
    """Gold spans after a log of edits (item_id, seq, op add or miss, document_id, start_offset, end_offset, grade).

    A miss replaces all spans of its item by a miss mark; an added span clears the mark; the same offsets again change the
    grade. Spans that end behind their document's text, or of documents (document_id, status, display_text) that are not
    ready, are refused and clear nothing. seq orders an item's edits and is unique in it. The last miss of an item is an
    aggregation, no window: an item with many edits is combined before the shuffle.
    """
    ready = documents.where("status = 'ready'").select("document_id", F.length("display_text").alias("chars"))
    added = edits.where("op = 'add'").join(ready, "document_id").where("chars > 0 and end_offset <= chars")
    misses = edits.where("op = 'miss'").groupBy("item_id").agg(F.max("seq").alias("last_miss"))
    live = added.join(misses, "item_id", "left").where("last_miss is null or seq > last_miss")
    spans = live.groupBy("item_id", "document_id", "start_offset", "end_offset").agg(F.max_by("grade", "seq").alias("grade"))
    marks = misses.join(live.select("item_id").distinct(), "item_id", "left_anti")
    nothing = [F.lit(None).cast("long").alias("document_id"), F.lit(0).alias("start_offset"), F.lit(0).alias("end_offset"), F.lit(None).cast("int").alias("grade")]
    return spans.withColumn("is_miss", F.lit(False)).unionByName(marks.select("item_id", *nothing, F.lit(True).alias("is_miss")))


def validated_scopes(items: DataFrame, documents: DataFrame) -> DataFrame:
    """items (item_id, mode, document_ids, file_names) with resolved ids, errors and status of explicit scopes.

    Ids first, then names, each resolved against the ready documents; a document named twice counts once; each miss is an
    error. Scopes that routing decides are not checked. File names of ready documents are unique.
    """
    ready = documents.where("status = 'ready'")
    ids = F.transform("document_ids", lambda i: F.struct(i.alias("id"), F.lit(None).cast("string").alias("name")))
    names = F.transform("file_names", lambda n: F.struct(F.lit(None).cast("long").alias("id"), n.alias("name")))
    asked = items.where("mode <> 'routing'").select("item_id", F.posexplode(F.concat(ids, names)).alias("place", "w"))
    asked = asked.select("item_id", "place", F.col("w.id").alias("id"), F.col("w.name").alias("name"))
    found = asked.join(ready.select(F.col("document_id").alias("id"), F.col("document_id").alias("by_id")), "id", "left")
    found = found.join(ready.select(F.col("file_name").alias("name"), F.col("document_id").alias("by_name")), "name", "left")
    error = F.when(F.col("id").isNotNull(), F.concat(F.lit("invalid_document_id:"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("invalid_document_file_name:"), "name"))
    row = F.struct("place", F.coalesce("by_id", "by_name").alias("document_id"), error.alias("error"))
    lists = found.groupBy("item_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))  # as long as the item's own lists
    hit = F.array_distinct(F.transform(F.filter("rows", lambda r: r["document_id"].isNotNull()), lambda r: r["document_id"]))
    miss = F.transform(F.filter("rows", lambda r: r["document_id"].isNull()), lambda r: r["error"])
    out = items.select("item_id", "mode").join(lists.select("item_id", hit.alias("resolved"), miss.alias("errors")), "item_id", "left")
    status = F.when(F.col("mode") == "routing", "routing").when(F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0, "invalid").otherwise("validated")
    return out.withColumn("status", status)


def partial_item(task_type: Column, statuses: Column) -> Column:
    """The task's main metric or the overall score is not scored; statuses maps metrics to their status."""
    main = F.when(task_type == "document_summary", SUMMARY_METRIC).otherwise(COMPARE_METRIC)
    scored = lambda name: F.coalesce(F.try_element_at(statuses, name), F.lit("")) == "scored"
    return ~(scored(main) & scored(F.lit(OVERALL_METRIC)))


def complete_citations(citations: DataFrame) -> DataFrame:
    """Citations (context_index, context_label, document_id, document_name, heading, structure_kind, start_offset,
    end_offset, excerpt, source, truncated) with the default of each field that is null or blank."""
    index = F.coalesce("context_index", F.lit(0))
    word = lambda c, default: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(default)).alias(c)
    return citations.withColumns(
        {
            "context_index": index,
            "context_label": F.when(F.trim(F.coalesce("context_label", F.lit(""))) != "", F.col("context_label")).otherwise(F.concat(F.lit("C"), (index + 1).cast("string"))),
            "document_id": word("document_id", ""),
            "document_name": word("document_name", ""),
            "heading": F.trim("heading"),
            "structure_kind": word("structure_kind", "text"),
            "start_offset": F.coalesce("start_offset", F.lit(0)),
            "end_offset": F.coalesce("end_offset", F.lit(0)),
            "excerpt": word("excerpt", ""),
            "source": word("source", "benchmark"),
            "truncated": F.coalesce("truncated", F.lit(False)),
        }
    )


def cited_names(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, document_name of cited documents: the table's file name, else the last name that a citation (place,
    document_id, document_name) gives; documents without either are left out."""
    named = F.when(F.col("document_name") != "", F.struct("place", "document_name"))
    told = citations.where("document_id is not null").groupBy("document_id").agg(F.max(named)["document_name"].alias("told"))
    names = told.join(documents.select("document_id", "file_name"), "document_id", "left")
    return names.select("document_id", F.coalesce("file_name", "told").alias("document_name")).where("document_name is not null")
