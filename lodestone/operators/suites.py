"""Runs of benchmark suites and checkpoints that go on where they stopped, and the checkpoint's report.

Items are worked in waves, in the order of their ids. A wave is one Spark job; its results become visible together when its
folder is committed, so a run that is killed loses the wave that it was in and nothing else. A later run with the same
settings works on what no committed wave holds. One failed item is a row with its status, never a failed run.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import folder as scratch_folder
from ..sources.scratch import once
from . import gates

#: Items of a wave.
WAVE = 256
#: States of an item that a run may be told to try again.
FAILED = ["judge_failed", "runtime_failed", "missing"]
#: What a report advises for each category of failure (fixed values).
ADVICE = [
    (["task_type_mismatch"], "優先調整 query type classifier 與 compare/summary cue，避免 task routing 走錯 lane。"),
    (["summary_strategy_mismatch"], "檢查 single-document mention resolver 與 section_focused 規則，避免摘要策略誤判。"),
    (["required_document_not_cited"], "檢查 document recall 與 diversified selection，確保必需文件都有代表 context 進入 synthesis。"),
    (["judge_low_faithfulness"], "優先收緊 synthesis 與 compare 文案，避免回答超出 citations 可支持的內容。"),
    (["judge_low_completeness"], "檢查 map/reduce 是否有遺漏 required claims 或 compare axes，必要時增加 refine 或 coverage guardrail。"),
    (["judge_low_coverage"], "檢查 section recall 與 section synopsis 命中情況，避免 section-focused 題目抓到錯章節。"),
    (["fallback_rate", "timeout"], "檢查 runtime budget、section recall 與 retrieval fallback，降低 checkpoint lane 的 timeout 與 fallback。"),
]
#: Items below this overall score are listed as failed (fixed value).
LOW = 3.0


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def waves(spark: SparkSession, folder: str) -> tuple[list[str], int]:
    """(paths of committed waves, in order; number of the next wave). One entry a wave, not an item."""
    path, fs = _fs(spark, f"{folder}/waves")
    if not fs.exists(path):
        return [], 0
    names = sorted(s.getPath().getName() for s in fs.listStatus(path))
    done = [n for n in names if fs.exists(_fs(spark, f"{folder}/waves/{n}/_SUCCESS")[0])]
    return [f"{folder}/waves/{n}" for n in done], max((int(n) + 1 for n in names), default=0)


def results(spark: SparkSession, folder: str, key: str = "item_id") -> DataFrame | None:
    """The last committed result of each item, with wave and attempts; None before any wave is committed."""
    done, _ = waves(spark, folder)
    if not done:
        return None
    rows = spark.read.parquet(*done).withColumn("wave", F.regexp_extract(F.input_file_name(), r"/waves/(\d+)/", 1).cast("int"))
    rest = [c for c in rows.columns if c not in (key, "wave")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "wave").alias("r"), F.max("wave").alias("wave"), F.count(F.lit(1)).alias("attempts"))
    return last.select(key, "r.*", "wave", "attempts")


def _same_settings(spark: SparkSession, folder: str, settings: dict) -> None:
    told = json.dumps(settings, sort_keys=True, ensure_ascii=False)
    digest = hashlib.sha256(told.encode()).hexdigest()
    path, fs = _fs(spark, f"{folder}/settings/_SUCCESS")
    if fs.exists(path):
        held = spark.read.parquet(f"{folder}/settings").first()
        if held.digest != digest:
            raise ValueError(f"the run in {folder} has other settings: {held.settings}")
    else:
        spark.createDataFrame([(digest, told)], "digest string, settings string").write.mode("overwrite").parquet(f"{folder}/settings")


def run(items: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, settings: dict | None = None, wave: int = WAVE, key: str = "item_id", retry_failed: bool = False, progress: Callable[[dict], None] | None = None) -> DataFrame:
    """Results of all items: those of committed waves, and work(items) of the rest, wave by wave.

    items has each key once. work gives one row with `status` for each item it gets; one that it leaves out gets the status
    `missing`. With retry_failed, items whose last state is in FAILED are worked once more. Other settings than those
    the folder was begun with raise. An empty table of items gives work's columns and no rows. Items and committed results
    are read once a run, not once a wave.
    """
    spark = items.sparkSession
    _same_settings(spark, folder, settings or {})
    _, began = waves(spark, folder)
    held, todo = results(spark, folder, key), items
    if held is not None:
        settled = held.where(~F.col("status").isin(FAILED)) if retry_failed else held
        todo = items.join(settled.select(key), key, "left_anti")
    parts = _dealt(todo, wave, key)
    if held is None and not parts:
        parts = [todo.limit(0)]
    for number, part in enumerate(parts, began):
        part = part.repartition(spark.sparkContext.defaultParallelism, key)
        rows = part.select(key).join(work(part), key, "left").withColumn("status", F.coalesce("status", F.lit("missing")))
        rows.write.parquet(f"{folder}/waves/{number:06d}")
        if progress is not None:
            progress({"type": "wave_completed", "wave": number, "items": spark.read.parquet(f"{folder}/waves/{number:06d}").count()})
    return results(spark, folder, key)


def _dealt(items: DataFrame, wave: int, key: str) -> list[DataFrame]:
    """The waves of items, in the order of their keys, each from a folder of its own: a wave reads its items only.

    Items are sorted and numbered within ranges of keys; the ranges' counts, one row a range, say where each begins.
    """
    spark = items.sparkSession
    at = F.monotonically_increasing_id()
    ordered = once(items.repartitionByRange(key).sortWithinPartitions(key).withColumn("__at", at), "ordered")
    ordered = ordered.withColumn("__range", F.shiftright("__at", 33))
    counts = ordered.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before")
    total = F.sum("__n").over(Window.partitionBy()).alias("__total")
    starts = once(counts.select("__range", before, total), "starts")  # a row a range
    first = starts.first()
    if first is None:
        return []
    place = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)
    path = scratch_folder(spark, "waves")
    numbered = ordered.join(F.broadcast(starts), "__range").withColumn("__wave", F.floor(place / wave).cast("int"))
    numbered.select(*items.columns, "__wave").write.partitionBy("__wave").parquet(path)
    return [spark.read.schema(items.schema).parquet(f"{path}/__wave={k}") for k in range(-(-first["__total"] // wave))]


def manifest(spark: SparkSession, folder: str, key: str = "item_id") -> DataFrame:
    """(key, status, wave, attempts) of all items with a committed result."""
    held = results(spark, folder, key)
    return spark.createDataFrame([], f"{key} string, status string, wave int, attempts long") if held is None else held.select(key, "status", "wave", "attempts")


def load_suite(spark: SparkSession, folder: str) -> tuple[dict, list[dict], DataFrame]:
    """(manifest, manifests of its packages, items of all packages with benchmark_name, task_family and place).

    A folder holds manifest.json with dataset_packages (relative folders), or is one package: manifest.json and
    questions.jsonl. A package whose item_count is not its number of questions raises. Packages are a handful.
    """
    top = _manifest(spark, folder)
    packages = top.get("dataset_packages")
    paths = [folder if p == "." else f"{folder}/{p}" for p in packages] if packages is not None else [folder]
    if packages is None:
        top = {k: top.get(k) for k in ("benchmark_name", "version", "description")} | {"dataset_packages": ["."]}
    found, items = [], None
    for path in paths:
        m = _manifest(spark, path)
        rows = spark.read.json(f"{path}/questions.jsonl").withColumn("benchmark_name", F.lit(m["benchmark_name"])).withColumn("task_family", F.lit(m["task_family"]))
        n = rows.count()
        if n != m["item_count"]:
            raise ValueError(f"package {m['benchmark_name']}: item_count is {m['item_count']}, questions are {n}")
        found.append(m)
        items = rows if items is None else items.unionByName(rows, allowMissingColumns=True)
    return top, found, items


def _manifest(spark: SparkSession, folder: str) -> dict:
    path, fs = _fs(spark, f"{folder}/manifest.json")
    if not fs.exists(path):
        raise ValueError(f"{folder} has no manifest.json")
    return json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0])


def family_scores(scores: DataFrame) -> DataFrame:
    """(name, value, status) of the suite from scores (dataset, family, lang, value, status): by family, and by language and family."""
    sets = [[F.col("family")], [F.col("family"), F.col("lang")]]
    out = scores.groupingSets(sets, F.col("family"), F.col("lang")).agg(*gates.scored_mean("value", "status"), F.grouping("lang").alias("all_langs"))
    name = F.when(F.col("all_langs") == 1, F.concat("family", F.lit("_benchmark_score"))).otherwise(F.concat("lang", F.lit("_"), "family", F.lit("_score")))
    return out.select(name.alias("name"), "value", "status")


def checkpoint_lines(items: DataFrame, run_row: DataFrame) -> DataFrame:
    """(section, place, line): a checkpoint's report as lines, ordered by section and place; failed items may be any number.

    items: what gates.aggregate() and gates.failure_categories() read, with item_id; run_row: one row of benchmark_name,
    version, area_id, judge_model, thinking_mode, answer_path.
    """
    metrics = gates.aggregate(items)
    passed = gates.gates(metrics)
    four = lambda c: F.format_string("%.4f", F.col(c).cast("double"))
    shown = lambda label, c: F.concat(F.lit(f"- {label}: `"), c, F.lit("`"))
    yes = lambda c: F.initcap(c.cast("string"))

    def listed(section: int, rows: DataFrame, columns: list) -> DataFrame:
        return rows.select(F.posexplode(F.array(*columns)).alias("p", "line")).select(F.lit(section).alias("section"), F.format_string("%06d", "p").alias("place"), "line")

    totals = items.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(passed.agg(F.min("passed").alias("ok"))))  # one row each
    head = listed(
        0,
        run_row.crossJoin(F.broadcast(totals)),
        [
            F.lit("# Phase 8A Summary / Compare Checkpoint"),
            shown("Passed", yes(F.col("ok"))),
            F.concat(F.lit("- Benchmark: `"), "benchmark_name", F.lit("` `"), "version", F.lit("`")),
            shown("Area ID", F.col("area_id")),
            shown("Judge Model", F.col("judge_model")),
            shown("Thinking Mode", yes(F.col("thinking_mode"))),
            shown("Answer Path", F.col("answer_path")),
            shown("Item Count", F.col("n").cast("string")),
        ],
    )
    labels = [("Task Type Accuracy", "task_type_accuracy"), ("Summary Strategy Accuracy", "summary_strategy_accuracy"), ("Required Document Coverage", "required_document_coverage"), ("Citation Coverage", "citation_coverage"), ("Section Coverage", "section_coverage"), ("Fallback Rate", "fallback_rate"), ("Avg Faithfulness", "avg_faithfulness_to_citations"), ("Avg Overall Score", "avg_overall_score"), ("p95 Latency", "p95_latency_seconds")]
    means = listed(1, metrics, [F.lit("## Aggregate Metrics"), *[shown(name, four(c)) for name, c in labels], shown("Timeout Count", F.col("timeout_count").cast("int").cast("string"))])
    order = F.create_map(*[x for i, (name, *_) in enumerate(gates.GATES) for x in (F.lit(name), F.lit(i))])
    verdict = F.concat(F.lit("- `"), "name", F.lit("`: "), F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.lit(" (actual="), four("actual"), F.lit(" "), "comparator", F.lit(" threshold="), four("threshold"), F.lit(")"))
    gate_lines = passed.select(F.lit(2).alias("section"), F.format_string("%06d", order[F.col("name")]).alias("place"), verdict.alias("line"))
    seen = gates.failure_categories(items).agg(F.collect_set("category").alias("seen"))  # categories are a handful
    advice = F.filter(F.array(*[F.when(F.arrays_overlap("seen", F.array(*map(F.lit, names))), F.lit(line)) for names, line in ADVICE]), lambda x: x.isNotNull())
    told = seen.select(F.posexplode(F.when(F.size(advice) > 0, F.transform(advice, lambda x: F.concat(F.lit("- "), x))).otherwise(F.array(F.lit("- 無")))).alias("p", "line")).select(F.lit(3).alias("section"), F.format_string("%06d", "p").alias("place"), "line")
    bad = items.where((F.size("blockers") > 0) | (F.col("overall") < LOW))
    failed = bad.select(F.lit(4).alias("section"), F.col("item_id").cast("string").alias("place"), F.concat(F.lit("- `"), F.col("item_id").cast("string"), F.lit("`: blockers="), F.coalesce(F.nullif(F.array_join("blockers", ", "), F.lit("")), F.lit("none")), F.lit("; overall="), F.format_string("%.2f", "overall")).alias("line"))
    out = head.unionByName(means).unionByName(gate_lines).unionByName(told).unionByName(failed)
    none = bad.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(4).alias("section"), F.lit("").alias("place"), F.lit("- 無").alias("line"))
    return out.unionByName(none)
