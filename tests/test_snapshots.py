import json
from datetime import datetime

import pytest

from lodestone.operators import snapshots

NOW = datetime(2024, 5, 1)
DOCS = "document_id string, area_id string, file_name string, status string, display_text string"


def _package(folder, spans=None, questions=None):
    folder.mkdir()
    (folder / "manifest.json").write_text(json.dumps({"benchmark_name": "bench", "dataset": {"dataset_id": "d1", "query_type": "fact_lookup"}}))
    (folder / "documents.jsonl").write_text('{"document_id": "x", "file_name": "a.md"}\n')
    questions = questions or [{"question_id": f"q{i}", "query_type": "fact_lookup", "language": "zh_tw" if i else "en", "question": f"why {i}?", **({"notes": "n"} if i else {})} for i in range(3)]
    spans = spans or [{"span_id": "s0", "question_id": "q0", "file_name": "a.md", "start_offset": 0, "end_offset": 5, "relevance_grade": 3}, {"span_id": "s1", "question_id": "q1", "file_name": "b.md", "start_offset": 2, "end_offset": 7}, {"span_id": "s2", "question_id": "q2", "is_retrieval_miss": True, "start_offset": 0, "end_offset": 0}]
    (folder / "questions.jsonl").write_text("\n".join(map(json.dumps, questions)) + "\n")
    (folder / "gold_spans.jsonl").write_text("\n".join(map(json.dumps, spans)) + "\n")
    return str(folder)


def _docs(spark):
    return spark.createDataFrame([("10", "one", "a.md", "ready", "hello world"), ("11", "one", "b.md", "ready", "some text"), ("12", "one", "b.md", "ready", "longer text"), ("20", "two", "a.md", "ready", "hello world"), ("21", "two", "b.md", "ready", "some text"), ("30", "three", "a.md", "processing", "hello world")], DOCS)


def _rows(spark, store, name):
    return sorted(map(str, snapshots.table(spark, store, "d1", name).collect()))


def _lines(folder, name):
    return sorted(line for p in (folder / name).glob("part-*") for line in p.read_text().splitlines())


def test_import_of_an_export_is_the_same_twice(spark, tmp_path):
    docs, store = _docs(spark), f"{tmp_path}/store"
    got = snapshots.import_snapshot(spark, _package(tmp_path / "p"), store, "one", docs, "me", NOW)
    assert got == {"benchmark_name": "bench", "dataset_id": "d1", "dataset_name": "bench", "area_id": "one", "question_count": 3, "span_count": 3, "mapped_document_count": 2, "replace": False}
    assert {r.span_id: r.document_id for r in snapshots.table(spark, store, "d1", "spans").collect()} == {"s0": "10", "s1": "11", "s2": None}
    first = {n: _rows(spark, store, n) for n in snapshots.TABLES}
    snapshots.export_snapshot(spark, store, "d1", docs, f"{tmp_path}/e1")
    for _ in range(2):
        snapshots.import_snapshot(spark, f"{tmp_path}/e1", store, "one", docs, "me", NOW, replace=True)
        assert {n: _rows(spark, store, n) for n in snapshots.TABLES} == first
    # another area: other ids, the same spans; and back again
    snapshots.import_snapshot(spark, f"{tmp_path}/e1", f"{tmp_path}/other", "two", docs, "me", NOW, name="renamed")
    assert {r.span_id: r.document_id for r in snapshots.table(spark, f"{tmp_path}/other", "d1", "spans").collect()} == {"s0": "20", "s1": "21", "s2": None}
    snapshots.export_snapshot(spark, f"{tmp_path}/other", "d1", docs, f"{tmp_path}/e2", "bench")
    assert [json.loads(x)["span_text"] for x in _lines(tmp_path / "e1", "gold_spans.jsonl") if "span_text" in x] == ["hello", "me te"]
    assert _lines(tmp_path / "e2", "questions.jsonl") == _lines(tmp_path / "e1", "questions.jsonl")


def test_a_cut_off_import_is_not_seen(spark, tmp_path):
    docs, store = _docs(spark), f"{tmp_path}/store"
    snapshots.import_snapshot(spark, _package(tmp_path / "p"), store, "one", docs, "me", NOW)
    before = _rows(spark, store, "spans")
    spark.createDataFrame([("s9",) + (None,) * 8], snapshots.TABLES["spans"]).write.parquet(f"{store}/dataset=d1/v=1/spans")
    assert _rows(spark, store, "spans") == before and snapshots.version(spark, store, "d1") == (0, 2)
    snapshots.import_snapshot(spark, f"{tmp_path}/p", store, "one", docs, "you", NOW, replace=True)
    assert snapshots.version(spark, store, "d1") == (2, 3)


def test_nothing_is_written_unless_all_fits(spark, tmp_path):
    docs, store = _docs(spark), f"{tmp_path}/store"
    span = {"span_id": "s", "question_id": "q0", "file_name": "a.md", "start_offset": 0, "end_offset": 5}
    bad = [
        ([span | {"file_name": "none.md"}], None, "no ready document for: none.md"),
        ([span | {"question_id": "q9"}], None, "spans of no question: q9"),
        ([span | {"end_offset": 99}], None, "spans beyond their document: s"),
        (None, [{"question_id": "q0", "query_type": "poem", "language": "en", "question": "x"}], "unknown query types: poem"),
        (None, [{"question_id": "q0", "query_type": "fact_lookup", "language": "fr", "question": "x"}], "unknown languages: fr"),
    ]
    for i, (spans, questions, message) in enumerate(bad):
        with pytest.raises(ValueError, match=message):
            snapshots.import_snapshot(spark, _package(tmp_path / f"b{i}", spans, questions), store, "one", docs, "me", NOW)
    with pytest.raises(ValueError, match="no ready document for: a.md, b.md"):
        snapshots.import_snapshot(spark, _package(tmp_path / "p"), store, "three", docs, "me", NOW)
    (tmp_path / "p/questions.jsonl").unlink()
    with pytest.raises(ValueError, match="lacks questions.jsonl"):
        snapshots.import_snapshot(spark, f"{tmp_path}/p", store, "one", docs, "me", NOW)
    assert snapshots.datasets(spark, store).count() == 0


def test_datasets(spark, tmp_path):
    docs, store = _docs(spark), f"{tmp_path}/store"
    snapshots.import_snapshot(spark, _package(tmp_path / "p"), store, "one", docs, "me", NOW)
    snapshots.create_dataset(spark, store, "d2", "two", " empty ", "document_summary", "me", NOW)
    got = [(r.dataset_id, r.name, r["items"], r.spans, r.runs) for r in snapshots.datasets(spark, store).collect()]
    assert got == [("d1", "bench", 3, 3, 0), ("d2", "empty", 0, 0, 0)]
    assert [r.dataset_id for r in snapshots.datasets(spark, store, "two").collect()] == ["d2"]
    for args in (("d2", "two", "x", "fact_lookup"), ("d3", "two", " ", "fact_lookup"), ("d3", "two", "x", "poem")):
        with pytest.raises(ValueError):
            snapshots.create_dataset(spark, store, *args, "me", NOW)
    with pytest.raises(ValueError, match="already"):
        snapshots.import_snapshot(spark, f"{tmp_path}/p", store, "one", docs, "me", NOW)
    snapshots.remove(spark, store, "d1")
    assert [r.dataset_id for r in snapshots.datasets(spark, store).collect()] == ["d2"]
