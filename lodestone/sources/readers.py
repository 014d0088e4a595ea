"""Sources and sinks: files, table-like rows, paged rows, JSON, artifacts."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scratch import once


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """document_id, file_name, content of the files of a folder; the id is a hash of the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.abs(F.xxhash64("path")).alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")


def read_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a csv, tsv, json or jsonl file; a json object may hold its rows under data or rows."""
    reader = spark.read.schema(schema) if schema else spark.read
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if extension in ("csv", "tsv"):
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path, sep="\t" if extension == "tsv" else ",")
    if extension == "jsonl":
        return reader.json(path)
    if extension == "parquet":
        return reader.parquet(path)
    whole = spark.read.option("multiLine", True).json(path)
    if "_corrupt_record" in whole.columns:
        return reader.json(path)
    for key in ("data", "rows"):
        if whole.columns == [key] or (key in whole.columns and dict(whole.dtypes)[key].startswith("array<struct")):
            return whole.select(F.explode(key).alias("r")).select("r.*")
    return whole


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; null fields are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def reusable(files: DataFrame, artifacts: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(files still to parse, artifacts to reuse): an anti-join and a semi-join on the key."""
    return files.join(artifacts.select(key), key, "left_anti"), artifacts.join(files.select(key), key, "left_semi")


def write_artifacts(blocks: DataFrame, path: str, key: str = "document_id", buckets: int = 64) -> None:
    """Parsed blocks by bucket of the document. Documents written again are replaced; all others of the buckets that are
    rewritten stay, as they are merged in before."""
    spark = blocks.sparkSession
    bucketed = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    new = once(bucketed(blocks), "artifacts")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets`
        held = spark.read.option("mergeSchema", True).parquet(path).where(F.col("bucket").isin(touched))
        new = new.unionByName(once(held.join(new.select(key).distinct(), key, "left_anti"), "artifacts"), allowMissingColumns=True)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


class _Pages(InputPartition):
    def __init__(self, first: int, step: int):
        self.first, self.step = first, step


def http_pages(base: str) -> Callable[[int, int], list[dict]]:
    """Fetcher of row pages from an HTTP endpoint that takes offset and length and answers {"rows": [{"row": ...}]}."""

    def fetch(offset: int, length: int) -> list[dict]:
        with urllib.request.urlopen(f"{base}&{urllib.parse.urlencode({'offset': offset, 'length': length})}", timeout=60) as r:
            return [x["row"] for x in json.load(r)["rows"]]

    return fetch


class PagedRows(DataSource):
    """Rows behind a paged source, read to its end: spark.read.format("paged_rows").

    Options: url (an endpoint for http_pages) or file (a JSON-lines file that all executors see, for tests), length (rows
    of a page), readers (tasks: task i reads pages i, i + readers, ... until a page comes back short or empty), pages (at
    most so many; default all).
    """

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "page int, row string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self):
        n = int(self.options.get("readers", "4"))
        return [_Pages(i, n) for i in range(n)]

    def read(self, partition: _Pages):
        length, last = int(self.options.get("length", "100")), self.options.get("pages")
        if "file" in self.options:
            with open(self.options["file"], encoding="utf-8") as f:
                held = [json.loads(x) for x in f if x.strip()]
            fetch = lambda offset, n: held[offset : offset + n]
        else:
            fetch = http_pages(self.options["url"])
        page = partition.first
        while last is None or page < int(last):
            rows = fetch(page * length, length)
            for row in rows:
                yield page, json.dumps(row, ensure_ascii=False)
            if len(rows) < length:
                break
            page += partition.step


def hub_reference(reference: str) -> tuple[str, str, str] | None:
    """(dataset, config, split) of hf://namespace/dataset/config/split; None for anything else."""
    parts = reference.removeprefix("hf://").split("/") if reference.startswith("hf://") else []
    return (f"{parts[0]}/{parts[1]}", parts[2], parts[3]) if len(parts) == 4 and all(parts) else None
