"""Every registered query with an oracle gives DuckDB's rows; the others run."""

import os
import re

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from lodestone.plans import catalog, retrieval

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    assert oracle.compare(spark, con, SF, catalog.QUERIES[name], catalog.ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["vector_topk", "rrf_fusion", "document_recall_hybrid", "section_recall_hybrid"])
def test_oracle_with_more_vectors(spark, tmp_path, name):
    """Embeddings beyond those that the SQL reaches change no row."""
    for t in "documents", "benchmark":
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    more = e.withColumns({"vec_id": F.col("vec_id") + 500, "embedding": F.reverse("embedding")})
    e.unionByName(more).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in "documents", "benchmark", "embeddings":
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert oracle.compare(spark, con, str(tmp_path), catalog.QUERIES[name], catalog.ORACLES[name]) == ""


@pytest.fixture(scope="module")
def far_vectors(spark, tmp_path_factory):
    """The tables with embeddings beyond those that the SQL reaches: of a key's own number, modulo as many as there are, each chunk
    would take the vector of some question."""
    sf = str(tmp_path_factory.mktemp("far"))
    for t in "documents", "benchmark":
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{sf}/{t}.parquet")
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = e.where("vec_id < 40").select((F.col("vec_id") + 1).alias("at"), "embedding", "label")
    more = spark.range(500, 20_000).withColumn("at", 40 - F.col("id") % 40).join(asked, "at").select(F.col("id").alias("vec_id"), "embedding", "label")
    e.unionByName(more).write.parquet(f"{sf}/embeddings.parquet")
    return sf


@pytest.mark.parametrize("name", ["assembled_full_parents", "chat_citations", "context_payloads", "document_selection", "parent_rerank", "ranking_policy", "select_compare"])
def test_later_stages_with_more_vectors(spark, far_vectors, name):
    """Embeddings beyond those that the SQL reaches change no row of what is made of the candidates."""
    con = duckdb.connect()
    for t in "documents", "benchmark", "embeddings":
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{far_vectors}/{t}.parquet/*.parquet'")
    assert oracle.compare(spark, con, far_vectors, catalog.QUERIES[name], catalog.ORACLES[name]) == ""


def test_stage_metrics_with_more_vectors(spark, tmp_path):
    """Two documents hold the passage; the vector that the SQL gives each decides which comes first, and so nDCG: those beyond would turn it."""
    passage = "alpha beta gamma delta epsilon"
    docs = [(33, passage), (35, passage), *((d, "other words") for d in range(36, 42))]
    away = {33 * 31 % 500, 35 * 31}
    spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, [-1.0 if i in away else 1.0, 0.0], 0) for i in range(2000)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in "documents", "benchmark", "embeddings":
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    name = "stage_metrics"
    assert oracle.compare(spark, con, str(tmp_path), catalog.QUERIES[name], catalog.ORACLES[name]) == ""
    assert [r.ndcg for r in catalog.QUERIES[name](spark, str(tmp_path)).where("stage = 'recall'").collect()] == [1.0]


@pytest.mark.parametrize("name", ["tool_payloads", "tool_summaries"])
def test_tool_calls_read_documents_beforehand(spark, name):
    """The three chunks a question are written once; what is made of them reads no document again."""
    assert not [f for f in catalog.QUERIES[name](spark, SF).inputFiles() if "documents.parquet" in f]


@pytest.mark.parametrize("name", ["hybrid_retrieval_eval", "assembled_contexts", "metric_breakdown"])
def test_evaluation_reads_documents_beforehand(spark, name):
    """Candidates, and the documents of those that are selected, are written once; what is made of them reads no other document."""
    assert not [f for f in catalog.QUERIES[name](spark, SF).inputFiles() if "documents.parquet" in f]


def test_chunks_stay_where_they_are_for_their_vectors(spark):
    """However large embeddings are: only those that the modulus reaches are sent."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = retrieval._chunks(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_llm_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "lodestone")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"\bllm\b|corpus_pipeline", open(os.path.join(folder, f), encoding="utf-8").read())
