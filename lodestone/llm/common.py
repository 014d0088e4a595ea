"""Shared pieces: durable tables in the shared folder, balanced row numbers, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where unset (tests) a temporary one.

    A temporary folder is shared only in local mode; on a cluster without the setting this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lodestone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: one computation, lineage cut, no executor holds it.

    The files' path is kept as attribute `durable_path` of the result.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a durable table that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.durable_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch of texts; a worker and its JVM hold a few batches at a time.
BATCH = 8 << 20


def lean(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are at most BATCH bytes; a smaller limit of the session's own stays.

    A batch always holds at least one row, so texts of any length pass whole.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    held = conf.get(key, None)
    if held is None or not held.rstrip("b").isdigit() or int(held.rstrip("b")) > BATCH:
        conf.set(key, f"{BATCH}b")
    return df


def by_row(n: int) -> Column:
    """A bucket from 0 to n-1 by the row's place in its partition, to split groups of any size and of equal rows.

    Materialise it with durable(): other plans would number the rows anew.
    """
    return F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")


def fresh(names: list[str], base: str) -> str:
    """A column name that none of the names equals, whatever the case of letters."""
    taken = {x.lower() for x in names}
    while base.lower() in taken:
        base += "_"
    return base


#: A key with more than one of so many rows is hot: there are fewer such keys than this, whatever the table.
HOT = 512


def hot_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join of durable rows with a table that has each key once, where a key may hold any share of the rows.

    Keys with more than 1/HOT of all rows are fewer than HOT; they are looked up in the scan, so that their rows are
    not shuffled at all. All other keys are joined by a shuffle in which none is large. Tables of under HOT * HOT rows
    have no key that is much for one task and are joined as they are.
    """
    held = rows.select(key)
    n = held.count()
    if n < HOT * HOT:
        return rows.join(table, key, how)
    hot = [r[0] for r in held.groupBy(key).count().where(F.col("count") > n // HOT).select(key).collect()]  # fewer than HOT
    if not hot:
        return rows.join(table, key, how)
    few = F.broadcast(table.where(F.col(key).isin(hot)))  # fewer than HOT rows
    cold = ~F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.where(~cold).join(few, key, how).unionByName(rows.where(cold).join(table, key, how))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table with long ends: (node, root), one row per node of an edge.

    Randomised contraction: each round every node hooks to the neighbour (or itself) with the smallest
    hash under a new seed, edges are rewritten to the hooks, and edges inside a hook vanish. Nodes shrink by
    a constant factor a round whatever the shape (long chains included), hubs are pre-aggregated before
    the shuffle, and every round is a durable table, so no lineage grows. Empty input gives an empty table.
    """
    spark = edges.sparkSession
    live = durable(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b"), "edges")
    hooks: list[DataFrame] = []
    for seed in range(max_rounds):
        if live.isEmpty():
            release(live)
            break
        rank = lambda c: F.xxhash64(F.lit(seed), F.col(c))
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("h"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(rank("a").alias("h"), F.col("a").alias("to"))
        hook = durable(nearest.select(F.col("a").alias("node"), F.least("m", own)["to"].alias("root")), "hooks")
        hooks.append(hook)
        left, right = hook.toDF("a", "ra"), hook.toDF("b", "rb")
        half = durable(hot_join(live, left, "a").select("ra", "b"), "edges")  # a hub's edges are no single task's
        after = hot_join(half, right, "b").where("ra <> rb")
        after = durable(after.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        release(half)
        release(live)
        live = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not hooks:
        return spark.createDataFrame([], "node long, root long")
    out = hooks[-1]
    for earlier in reversed(hooks[:-1]):  # from the last round back: each step reads that round's nodes only
        known = durable(out, "roots").toDF("root", "next")
        out = hot_join(earlier, known, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, bucket: str) -> DataFrame:
    """Gapless row numbers from 0 within keys, without ever bringing one key's rows to one task.

    `bucket` is a column that deals the rows of a key evenly, by row and not by content, see by_row(): a third of all
    rows may share every other column. Numbers follow (bucket, order). A window sees one bucket's rows only, and
    bucket counts (a few hundred a key) give each bucket its start. Rows equal in `order` are numbered in any order.
    Keys must not be null. df is read twice: give it a durable table.
    """
    counts = df.groupBy(*keys, bucket).count()
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(bucket)
    starts = counts.withColumn("__start", F.sum("count").over(w) - F.col("count")).drop("count")
    inner = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)) - 1)
    joined = inner.join(starts, [*keys, bucket])
    return joined.select(*[c for c in df.columns if c != bucket], (F.col("__start") + F.col("__rn")).cast("long").alias(out))
