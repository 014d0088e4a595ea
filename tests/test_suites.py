import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import scorers, suites


def test_alignment_by_hand():
    table = {"cat": [1.0, 0.0], "dog": [0.6, 0.8], "car": [0.0, 1.0]}
    vectors = lambda tokens: np.array([table[t] for t in tokens])
    p, r, f = scorers.align(Counter({"cat": 2, "car": 1}), Counter({"dog": 1, "cat": 1}), vectors)
    assert p == pytest.approx((2 * 1.0 + 0.8) / 3) and r == pytest.approx((0.8 + 1.0) / 2) and f == pytest.approx(2 * p * r / (p + r))
    long = Counter({f"t{i}": 1 + i % 3 for i in range(3000)})
    assert scorers.align(long, long, scorers.hashed_vectors) == pytest.approx((1.0, 1.0, 1.0))


def test_alignment_states(spark):
    def broken():
        def call(tokens):
            if "bad" in tokens:
                raise OSError("no model")
            return scorers.hashed_vectors(tokens)

        return call

    rows = spark.createDataFrame([(1, "a b", "a b"), (2, " ", "a"), (3, "a", None), (4, "bad", "a"), (5, None, "a")], "i int, a string, r string")
    got = {r.i: r.s for r in rows.select("i", scorers.alignment_udf(broken)("a", "r").alias("s")).collect()}
    assert (got[1].f1, got[1].status) == (1.0, "scored") and got[3].f1 == 0.0
    assert got[2].status == got[5].status == "not_applicable" and got[2].reason == scorers.EMPTY_ANSWER
    assert got[4].reason == "BERTScore 執行失敗：OSError"
    assert spark.range(1).select(scorers.no_fact_score().alias("s")).first().s.status == "not_applicable"


def test_pairwise_in_both_orders(spark):
    def build():
        seen = Counter()

        def judge(question, first, second):
            seen[first, second] += 1
            if first == "flaky" and seen[first, second] < 3:
                raise RuntimeError("Rate limit reached")
            if "broken" in (first, second):
                raise ValueError("bad request")
            return "first" if first in ("good", "flaky") or second == "equal" else "second" if second in ("good", "flaky") else "first"

        return judge

    rows = spark.createDataFrame([("good", "poor"), ("poor", "good"), ("equal", "even"), ("broken", "poor"), ("flaky", "poor")], "a string, b string").coalesce(1)
    udf = scorers.pairwise_udf(build, sleep=lambda s: None)
    got = {r.a: r.v for r in rows.select("a", udf(F.lit("q"), "a", "b").alias("v")).collect()}
    assert (got["good"].verdict, got["good"].score) == ("candidate", 1.0) and (got["poor"].verdict, got["poor"].score) == ("reference", 0.0)
    assert (got["equal"].verdict, got["equal"].agreed, got["equal"].score) == ("tie", False, 0.5)
    assert got["broken"].status == "judge_failed" and "bad request" in got["broken"].reason
    assert got["flaky"].verdict == "candidate"
    system, user = scorers.pairwise_prompt("q", ["x"], ["c"], "ref", "cand", [("d", "h", "e" * 900)] * 9)
    body = json.loads(user)
    assert system == scorers.PAIRWISE_SYSTEM and len(body["citations"]) == 8 and len(body["citations"][0]["excerpt"]) == 600


def test_rubric_states(spark):
    build = lambda: lambda q, a, c: {"ok": dict.fromkeys(scorers.DIMENSIONS, 4.0), "half": {"completeness": 2.0}, "high": dict.fromkeys(scorers.DIMENSIONS, 9.0)}[a]
    rows = spark.createDataFrame([("ok",), ("half",), ("high",), ("none",)], "a string")
    got = {r.a: r.v for r in rows.select("a", scorers.rubric_udf(build)(F.lit(""), "a", F.lit("")).alias("v")).collect()}
    assert (got["ok"].overall, got["ok"].status) == (4.0, "scored")
    assert {got[k].status for k in ("half", "high", "none")} == {"judge_failed"}


def _work(seen, fail_at=None):
    def work(part):
        ids = sorted(r[0] for r in part.select("item_id").collect())
        if fail_at is not None and fail_at in ids:
            raise RuntimeError("killed")
        seen.extend(ids)
        status = F.when(F.col("item_id") % 5 == 4, "judge_failed").otherwise("scored")
        return part.where("item_id <> 6").select("item_id", (F.col("item_id") * 2.0).alias("value"), status.alias("status"))

    return work


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    items = spark.range(10).toDF("item_id")
    whole = sorted(map(str, suites.run(items, _work([]), f"{tmp_path}/whole", {"v": 1}, wave=3).collect()))
    seen, events = [], []
    with pytest.raises(RuntimeError):
        suites.run(items, _work(seen, fail_at=7), f"{tmp_path}/run", {"v": 1}, wave=3, progress=events.append)
    assert seen == [0, 1, 2, 3, 4, 5] and [e["items"] for e in events] == [3, 3]
    assert suites.manifest(spark, f"{tmp_path}/run").count() == 6
    # a wave that was being written when the run was killed is not seen
    spark.range(50, 60).selectExpr("id AS item_id", "0D AS value", "'scored' AS status").write.parquet(f"{tmp_path}/run/waves/000002")
    (tmp_path / "run/waves/000002/_SUCCESS").unlink()
    again = []
    got = sorted(map(str, suites.run(items, _work(again), f"{tmp_path}/run", {"v": 1}, wave=3).drop("wave").collect()))
    assert again == [6, 7, 8, 9]
    assert got == sorted(map(str, suites.results(spark, f"{tmp_path}/whole").drop("wave").collect())) and len(whole) == 10
    states = {r.item_id: r.status for r in suites.manifest(spark, f"{tmp_path}/run").collect()}
    assert states[6] == "missing" and states[4] == states[9] == "judge_failed"
    nothing = []
    suites.run(items, _work(nothing), f"{tmp_path}/run", {"v": 1}, wave=3)
    assert nothing == []
    with pytest.raises(ValueError, match="other settings"):
        suites.run(items, _work([]), f"{tmp_path}/run", {"v": 2})


def test_items_are_read_once_a_run(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    items = spark.range(60).toDF("item_id").mapInArrow(counted, "item_id long")
    out = suites.run(items, _work([]), f"{tmp_path}/r", wave=5).collect()
    assert sorted((r.item_id, r.wave) for r in out) == [(i, i // 5) for i in range(60)]
    assert seen.value <= 3 * 60  # ranges, then rows; once or twice a wave before


def test_failed_items_once_more(spark, tmp_path):
    items = spark.range(10).toDF("item_id")
    suites.run(items, _work([]), f"{tmp_path}/r", wave=4)
    seen = []
    mended = lambda part: _work(seen)(part).withColumn("status", F.lit("scored"))
    out = {r.item_id: (r.status, r.attempts) for r in suites.run(items, mended, f"{tmp_path}/r", wave=4, retry_failed=True).collect()}
    assert sorted(seen) == [4, 6, 9] and out[4] == ("scored", 2) and out[6] == ("missing", 2) and out[0] == ("scored", 1)


def test_empty_run(spark, tmp_path):
    assert suites.run(spark.range(0).toDF("item_id"), _work([]), f"{tmp_path}/e").count() == 0


def test_load_suite(spark, tmp_path):
    for name, family, n in (("one", "summary", 2), ("two", "compare", 1)):
        d = tmp_path / name
        d.mkdir()
        (d / "manifest.json").write_text(json.dumps({"benchmark_name": name, "version": "v1", "language": "en", "task_family": family, "item_count": n}))
        (d / "questions.jsonl").write_text("".join(json.dumps({"id": f"{name}-{i}", "question": "q", **({"comparison_axes": ["a"]} if family == "compare" else {"summary_strategy": "document_overview"})}) + "\n" for i in range(n)) + "\n")
    (tmp_path / "manifest.json").write_text(json.dumps({"benchmark_name": "all", "version": "v2", "dataset_packages": ["one", "two"]}, indent=1))
    top, packages, items = suites.load_suite(spark, str(tmp_path))
    assert top["version"] == "v2" and [p["benchmark_name"] for p in packages] == ["one", "two"]
    assert {(r.id, r.benchmark_name, r.task_family) for r in items.collect()} == {("one-0", "one", "summary"), ("one-1", "one", "summary"), ("two-0", "two", "compare")}
    assert suites.load_suite(spark, str(tmp_path / "one"))[0]["dataset_packages"] == ["."]
    (tmp_path / "one/manifest.json").write_text(json.dumps({"benchmark_name": "one", "task_family": "summary", "item_count": 3}))
    with pytest.raises(ValueError, match="item_count is 3, questions are 2"):
        suites.load_suite(spark, str(tmp_path))
    with pytest.raises(ValueError, match="manifest.json"):
        suites.load_suite(spark, str(tmp_path / "none"))


def test_family_scores(spark):
    rows = [("a", "summary", "en", 0.5, "scored"), ("b", "summary", "zh-TW", 0.7, "scored"), ("c", "compare", "en", None, "judge_failed")]
    got = {r.name: (r.value, r.status) for r in suites.family_scores(spark.createDataFrame(rows, "dataset string, family string, lang string, value double, status string")).collect()}
    assert got["summary_benchmark_score"] == (0.6, "scored") and got["compare_benchmark_score"] == (None, "judge_failed")
    assert got["en_summary_score"] == (0.5, "scored") and got["en_compare_score"] == (None, "judge_failed")
