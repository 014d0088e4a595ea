import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import fallback


def test_reading():
    assert [fallback.read_confidence(x) for x in (0.4, "0.9", 7, -1, None, "high")] == [0.4, 0.9, 1.0, 0.0, 0.7, 0.7]
    assert fallback.read_answer('{"label": " a ", "confidence": 2}', ["a"]) == ("a", 1.0)
    assert fallback.read_answer('{"label": "b"}', ["a"]) is None and fallback.read_answer("[]", ["a"]) is None and fallback.read_answer("", ["a"]) is None
    system, user = fallback.prompt("task_type", "q", "en", {"fact_lookup": "d"}, {"document_mention_candidates": []})
    assert system == fallback.INSTRUCTION and json.loads(user)["labels"] == [{"label": "fact_lookup", "description": "d"}]


ROWS = "query_id int, query_text string, language string, context string, label string, source string, confidence double"


def test_undecided_rows_only(spark):
    def build():
        asked = []

        def model(system, user):
            q = json.loads(user)["query"]
            asked.append(q)
            if q.startswith("decided"):
                raise AssertionError("a decided row was sent")
            if q == "slow" and asked.count(q) < 3:
                raise RuntimeError("Request timed out")
            if q == "broken":
                raise ValueError("no such model")
            if q == "never":
                raise RuntimeError("429")
            if q == "garbled" and asked.count(q) < 2:
                raise RuntimeError("We could not parse the JSON body of your request")
            return {"odd": '{"label": "poem"}', "vague": '{"label": "fact_lookup", "confidence": "sure"}', "text": "not json"}.get(q, '{"label": "document_summary", "confidence": 1.5}')

        return model

    texts = ["decided a", "slow", "broken", "never", "odd", "vague", "text", "plain", "plain", "garbled"]
    rows = spark.createDataFrame([(i, t, "en", None, "fact_lookup", "rule" if t.startswith("decided") else "fallback", 0.92) for i, t in enumerate(texts)], ROWS)
    label = fallback.label_udf(build, "task_type", fallback.TASK_TYPES, sleep=lambda s: None)
    got = {r.query_id: r for r in fallback.with_fallback(rows, label, F.array(*map(F.lit, fallback.TASK_TYPES)), F.lit("fact_lookup")).collect()}
    assert len(got) == len(texts)
    assert (got[0].label, got[0].source, got[0].confidence, got[0].fallback_used) == ("fact_lookup", "rule", 0.92, False)
    for i in (1, 7, 8, 9):
        assert (got[i].label, got[i].source, got[i].confidence, got[i].fallback_reason) == ("document_summary", "llm_fallback", 1.0, "low_embedding_confidence")
    for i in (2, 3, 4, 6):
        assert (got[i].label, got[i].source, got[i].confidence, got[i].fallback_used, got[i].fallback_reason) == ("fact_lookup", "fallback", 0.0, False, "llm_fallback_unavailable")
    assert (got[5].label, got[5].confidence) == ("fact_lookup", 0.7)


def test_strategies_that_fit(spark):
    rows = spark.createDataFrame([("area", 0), ("single_document", 1), ("multi_document", 0), ("area", 3), (None, 0)], "scope string, resolved int")
    got = [r[0] for r in rows.select(fallback.allowed_strategies(F.col("scope"), F.col("resolved"))).collect()]
    assert [len(x) for x in got] == [3, 2, 1, 1, 3] and got[1] == ["document_overview", "section_focused"] and got[2] == ["multi_document_theme"]
    with pytest.raises(KeyError):
        fallback.STRATEGIES["other"]


def test_mention_context(spark):
    rows = spark.createDataFrame([(1, "b.md", 0.8, 2), (1, "a.md", 0.9, 1), (1, "z.md", 0.7, 4)], "query_id int, file_name string, score double, place int")
    got = json.loads(fallback.mention_context(rows).first().context)
    assert [m["file_name"] for m in got["document_mention_candidates"]] == ["a.md", "b.md"] and got["document_mention_confidence"] == 0.9
