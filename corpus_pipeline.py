"""Corpus pipeline over documents: quality rules, near-duplicates, secrets, packing.

Each stage takes all its predecessor kept. In run() every stage's result is written as Parquet in the shared folder
and read again, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, packing, quality, secrets, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects.

    Null and empty texts have no words and go; null ids and repeated rows are judged like others; extra columns stay,
    whatever their names; without labels only the base rule rejects; no rows give no rows. Texts are read whole.
    """
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the least id.

    Null and empty texts are one component. A null id comes last in its component; of rows repeated with one id any one
    stays. Extra columns stay, whatever their names; no rows give no rows.
    """
    return simhash.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced, n_chars counted anew.

    All rows stay, repeated ones and null ids too; a null text stays null (n_chars null), an empty one empty; no rows give
    no rows. Texts are read whole.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens.

    A null text is empty and still has its end id; repeated rows and null ids are packed each for itself; a long text is
    cut and packed whole; no rows give no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the learned rules nor the packing; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.durable(docs, f"stage{k}")
    return docs
