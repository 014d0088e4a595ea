"""Ingest queue on Structured Streaming: at-least-once events, idempotent keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the last event of a job means; anything else leaves it queued.
STATES = {"purchase": "succeeded", "error": "failed", "click": "processing"}
#: How late a repeated delivery of an event may come.
REPEATS = "7 days"
#: Buckets of the keyed table; a batch rewrites only those that it touches.
BUCKETS = 64
_OUT = "document_id long, status string, events long"
_STATE = "ts timestamp, event_id long, event_type string, events long"


def job_status(event_type: Column) -> Column:
    out = F.lit("queued")
    for kind, status in STATES.items():
        out = F.when(event_type == kind, status).otherwise(out)
    return out


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last = state.get if state.exists else None
    events = 0 if last is None else last[3]
    best = None if last is None else last[:3]
    for pdf in batches:
        events += len(pdf)
        for row in pdf[["ts", "event_id", "event_type"]].itertuples(index=False):
            if best is None or (row[0], row[1]) > (best[0], best[1]):
                best = tuple(row)
    state.update((best[0], int(best[1]), best[2], int(events)))
    yield pd.DataFrame({"document_id": [key[0]], "status": [STATES.get(best[2], "queued")], "events": [events]})


def job_states(events: DataFrame) -> DataFrame:
    """Streaming state machine keyed by document: each micro-batch emits the new state of the documents it touched.

    The latest event by (ts, event_id) decides, whatever the order of arrival. An event that is delivered again within
    REPEATS of its time is dropped; the ids held for that are let go behind the watermark, so they do not grow for ever.
    An event that is older than the newest one by more than REPEATS when it comes is late and not read.
    """
    named = events.select(F.col("user_id").alias("document_id"), "ts", "event_id", "event_type")
    keyed = named.withWatermark("ts", REPEATS).dropDuplicatesWithinWatermark(["document_id", "event_id"])
    return keyed.groupBy("document_id").applyInPandasWithState(_advance, _OUT, _STATE, "update", "NoTimeout")


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Extension: hourly counts with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def _buckets(spark: SparkSession, target: str, before: int | None = None) -> dict[int, list[int]]:
    """By bucket the committed versions that hold it, the newest first; only those before an epoch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    for s in fs.listStatus(path) if fs.exists(path) else []:
        name = s.getPath().getName()
        if not name.startswith("v=") or (before is not None and int(name[2:]) >= before):
            continue
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            continue  # half written: its batch will come again
        for b in fs.listStatus(s.getPath()):
            if b.getPath().getName().startswith("bucket="):
                out.setdefault(int(b.getPath().getName()[7:]), []).append(int(name[2:]))
    return {b: sorted(v, reverse=True) for b, v in out.items()}


def current(spark: SparkSession, target: str, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
    """The keyed table as of its last committed version (or before an epoch): the newest version of every bucket."""
    held = _buckets(spark, target, before)
    paths = [f"{target}/v={v[0]}/bucket={b}" for b, v in held.items() if only is None or b in only]
    return spark.read.option("basePath", target).parquet(*paths).drop("v", "bucket") if paths else None


def upsert_batches(target: str, key: str = "document_id"):
    """A foreachBatch function that keeps the latest row of each key in a Parquet folder.

    A batch writes, as version v=<epoch>, the buckets that it touches: their rows of the newest version that was committed
    before, without the batch's keys, and the batch. The same epoch again writes the same version; a half-written one is
    never read. Of each bucket the version read from is kept beside the new one, older ones are deleted.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucketed = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        out = bucketed(batch)
        touched = [r.bucket for r in out.select("bucket").distinct().collect()]  # at most BUCKETS
        held = current(spark, target, epoch, touched)
        if held is not None:
            out = out.unionByName(bucketed(held.join(batch.select(key), key, "left_anti")))
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={epoch}")
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
        for b, versions in _buckets(spark, target).items():
            for v in versions[2:]:
                fs.delete(path(f"{target}/v={v}/bucket={b}"), True)

    return write
