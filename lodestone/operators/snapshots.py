"""Evaluation datasets as snapshots: exported to a folder of files, imported elsewhere with document ids mapped by file name.

The store holds each dataset as versions of all its tables: <store>/dataset=<id>/v=<n>/{dataset,items,spans,runs}. A version
counts once its marker is there, which is written after all tables; so an import is seen whole or not at all, and one that
was cut off is passed over. A dataset that is replaced loses its items, spans and runs together.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of a snapshot (fixed values).
FILES = ["manifest.json", "documents.jsonl", "questions.jsonl", "gold_spans.jsonl"]
#: Names that an error lists.
LISTED = 20
TABLES = {
    "dataset": "dataset_id string, area_id string, name string, query_type string, created_by string, created_at timestamp",
    "items": "item_id string, dataset_id string, query_type string, query_text string, language string, notes string, created_at timestamp",
    "spans": "span_id string, item_id string, document_id string, start_offset int, end_offset int, relevance_grade int, is_retrieval_miss boolean, created_by string, created_at timestamp",
    "runs": "run_id string, dataset_id string, status string, summary string",
}
_LANGUAGES = {"zh_tw": "zh-TW", "zh-TW": "zh-TW", "en": "en", "mixed": "mixed"}
_KINDS = ["fact_lookup", "document_summary", "cross_document_compare"]


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def version(spark: SparkSession, store: str, dataset_id: str) -> tuple[int | None, int]:
    """(last committed version or None, number of the next one) of a dataset."""
    path, fs = _fs(spark, f"{store}/dataset={dataset_id}")
    if not fs.exists(path):
        return None, 0
    numbers = sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v="))
    done = [n for n in numbers if fs.exists(_fs(spark, f"{store}/dataset={dataset_id}/v={n}/committed/_SUCCESS")[0])]
    return (done[-1] if done else None), (numbers[-1] + 1 if numbers else 0)


def table(spark: SparkSession, store: str, dataset_id: str, name: str) -> DataFrame:
    """A table of a dataset's last committed version; empty where there is none."""
    last, _ = version(spark, store, dataset_id)
    return spark.createDataFrame([], TABLES[name]) if last is None else spark.read.schema(TABLES[name]).parquet(f"{store}/dataset={dataset_id}/v={last}/{name}")


def commit(spark: SparkSession, store: str, dataset_id: str, tables: dict[str, DataFrame]) -> int:
    """Write all tables as the dataset's next version (those left out are empty), then its marker."""
    _, number = version(spark, store, dataset_id)
    base = f"{store}/dataset={dataset_id}/v={number}"
    for name, schema in TABLES.items():
        rows = tables.get(name, spark.createDataFrame([], schema))
        columns = [c.split()[0] for c in schema.split(", ")]
        rows.select(*columns).write.parquet(f"{base}/{name}")
    spark.createDataFrame([(number,)], "version int").write.parquet(f"{base}/committed")
    return number


def remove(spark: SparkSession, store: str, dataset_id: str) -> None:
    """Delete a dataset with all its versions."""
    path, fs = _fs(spark, f"{store}/dataset={dataset_id}")
    fs.delete(path, True)


def datasets(spark: SparkSession, store: str, area_id: str | None = None) -> DataFrame:
    """Datasets of the store (of an area): their row with the numbers of items, spans and runs, by name.

    A listing reads one row and three counts a dataset; datasets are what people make by hand.
    """
    path, fs = _fs(spark, store)
    ids = sorted(s.getPath().getName()[8:] for s in fs.listStatus(path) if s.getPath().getName().startswith("dataset=")) if fs.exists(path) else []
    live = [(i, version(spark, store, i)[0]) for i in ids]
    paths = lambda name: [f"{store}/dataset={i}/v={n}/{name}" for i, n in live if n is not None]
    if not paths("dataset"):
        return spark.createDataFrame([], TABLES["dataset"] + ", items long, spans long, runs long")
    read = lambda name: spark.read.schema(TABLES[name]).parquet(*paths(name))
    count = lambda rows, name: rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias(name))
    items = read("items").select("item_id", "dataset_id")
    out = read("dataset") if area_id is None else read("dataset").where(F.col("area_id") == area_id)
    for rows, name in ((items, "items"), (read("spans").join(items, "item_id"), "spans"), (read("runs"), "runs")):
        out = out.join(count(rows, name), "dataset_id", "left")
    return out.fillna(0, ["items", "spans", "runs"]).orderBy("name", "dataset_id")


def create_dataset(spark: SparkSession, store: str, dataset_id: str, area_id: str, name: str, query_type: str, actor: str, now: datetime) -> None:
    """A dataset without items; a blank name, an unknown kind or an id that is taken raises."""
    if not name.strip() or query_type not in _KINDS:
        raise ValueError("a dataset needs a name and a known query type")
    if version(spark, store, dataset_id)[0] is not None:
        raise ValueError(f"dataset {dataset_id} is there already")
    commit(spark, store, dataset_id, {"dataset": spark.createDataFrame([(dataset_id, area_id, name.strip(), query_type, actor, now)], TABLES["dataset"])})


def _write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def export_snapshot(spark: SparkSession, store: str, dataset_id: str, documents: DataFrame, folder: str, benchmark_name: str | None = None) -> dict:
    """Write a dataset with the documents (document_id, file_name, display_text) that its spans lie in; the manifest."""
    head = table(spark, store, dataset_id, "dataset").first()
    if head is None:
        raise ValueError(f"no dataset {dataset_id}")
    items, spans = table(spark, store, dataset_id, "items"), table(spark, store, dataset_id, "spans")
    named = spans.join(documents.select(F.col("document_id").cast("string").alias("document_id"), "file_name", "display_text"), "document_id", "left")
    cut = F.substring("display_text", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    out = named.select("span_id", F.col("item_id").alias("question_id"), "document_id", "file_name", "start_offset", "end_offset", "relevance_grade", "is_retrieval_miss", cut.alias("span_text"))
    _write_json(out, f"{folder}/gold_spans.jsonl")
    _write_json(items.select(F.col("item_id").alias("question_id"), "dataset_id", "query_type", "language", F.col("query_text").alias("question"), "notes"), f"{folder}/questions.jsonl")
    _write_json(named.where("document_id is not null").select("document_id", "file_name").distinct(), f"{folder}/documents.jsonl")
    manifest = {"benchmark_name": benchmark_name or head.name, "dataset": {"dataset_id": dataset_id, "query_type": head.query_type, "name": head.name}, "questions": items.count(), "spans": spans.count()}
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest.json")
    return manifest


def _raise_for(rows: DataFrame, column: str, message: str) -> None:
    """Raise with the first values of a column, if there are any."""
    found = [r[0] for r in rows.select(column).distinct().orderBy(column).limit(LISTED).collect()]
    if found:
        raise ValueError(f"{message}: {', '.join(map(str, found))}")


def import_snapshot(spark: SparkSession, folder: str, store: str, area_id: str, documents: DataFrame, actor: str, now: datetime, name: str | None = None, replace: bool = False) -> dict:
    """Import a snapshot into the store; a summary. Nothing is written unless all of it fits.

    documents: document_id, area_id, file_name, status, display_text. Spans find their document by file name among the ready
    ones of the area (of equal names the least id). Raises for a missing file, a document that is not there, a span of no
    question or beyond its document, an unknown language or kind, and a dataset that is there unless replace is set.
    """
    missing = [f for f in FILES if not _fs(spark, f"{folder}/{f}")[1].exists(_fs(spark, f"{folder}/{f}")[0])]
    if missing:
        raise ValueError(f"the snapshot lacks {', '.join(missing)}")
    manifest = json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/manifest.json", wholetext=True).collect()))
    dataset_id, kind = manifest["dataset"]["dataset_id"], manifest["dataset"]["query_type"]
    if kind not in _KINDS:
        raise ValueError(f"unknown query type {kind}")
    if version(spark, store, dataset_id)[0] is not None and not replace:
        raise ValueError(f"dataset {dataset_id} is there already")
    asked = spark.read.schema("question_id string, query_type string, language string, question string, notes string").json(f"{folder}/questions.jsonl")
    told = spark.read.schema("span_id string, question_id string, file_name string, start_offset int, end_offset int, relevance_grade int, is_retrieval_miss boolean").json(f"{folder}/gold_spans.jsonl").withColumn("is_retrieval_miss", F.coalesce("is_retrieval_miss", F.lit(False)))
    _raise_for(asked.where(~F.col("query_type").isin(_KINDS)), "query_type", "unknown query types")
    _raise_for(asked.where(~F.col("language").isin(list(_LANGUAGES))), "language", "unknown languages")
    ready = documents.where((F.col("area_id") == area_id) & (F.col("status") == "ready"))
    by_name = ready.groupBy("file_name").agg(F.min_by(F.struct(F.col("document_id").cast("string").alias("document_id"), F.length("display_text").alias("length")), "document_id").alias("d"))
    placed = told.where("not is_retrieval_miss").join(by_name, "file_name", "left")
    _raise_for(placed.where("d is null"), "file_name", "the area has no ready document for")
    _raise_for(told.join(asked, "question_id", "left_anti"), "question_id", "spans of no question")
    _raise_for(placed.where("start_offset < 0 or end_offset < start_offset or end_offset > d.length"), "span_id", "spans beyond their document")
    mapped = placed.select("span_id", F.col("d.document_id").alias("document_id"))
    spans = told.join(mapped, "span_id", "left").select("span_id", F.col("question_id").alias("item_id"), "document_id", "start_offset", "end_offset", "relevance_grade", "is_retrieval_miss", F.lit(actor).alias("created_by"), F.lit(now).alias("created_at"))
    language = F.create_map(*[F.lit(x) for pair in _LANGUAGES.items() for x in pair])[F.col("language")]
    items = asked.select(F.col("question_id").alias("item_id"), F.lit(dataset_id).alias("dataset_id"), "query_type", F.col("question").alias("query_text"), language.alias("language"), "notes", F.lit(now).alias("created_at"))
    head = spark.createDataFrame([(dataset_id, area_id, name or manifest["benchmark_name"], kind, actor, now)], TABLES["dataset"])
    commit(spark, store, dataset_id, {"dataset": head, "items": items, "spans": spans})
    found = told.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(~F.col("is_retrieval_miss"), F.col("file_name"))).alias("files")).first()
    return {"benchmark_name": manifest["benchmark_name"], "dataset_id": dataset_id, "dataset_name": name or manifest["benchmark_name"], "area_id": area_id, "question_count": asked.count(), "span_count": found.n, "mapped_document_count": found.files, "replace": replace}
