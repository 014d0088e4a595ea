"""Tunables that change results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Settings:
    """Defaults of the retrieval stack (fixed values)."""

    vector_top_k: int = 30
    fts_top_k: int = 30
    max_candidates: int = 30
    document_recall_top_k: int = 6
    rrf_k: int = 60
    rerank_top_n: int = 30
    rerank_max_chars: int = 2000
    assembler_max_contexts: int = 9
    assembler_max_chars: int = 3000
    assembler_max_children: int = 7
    query_variant_max_chars: int = 160
    latency_target_seconds: float = 20.0
    latency_max_seconds: float = 40.0
    eval_max_p95_seconds: float = 30.0
    eval_max_tokens: int = 12000
    eval_min_avg_score: float = 4.2
    min_parent_section_length: int = 800
    target_child_length: int = 800
    child_overlap: int = 120
    preview_length: int = 120
    txt_parent_group_size: int = 4
    fact_heavy_refinement: bool = False
    table_preserve_chars: int = 4000
    table_rows_per_child: int = 20
    synopsis_max_input_chars: int = 6000
    synopsis_max_output_chars: int = 1600
    embedding_dimensions: int = 1536


DEFAULTS = Settings()

#: Bytes of an Arrow batch of texts.
BATCH = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are at most BATCH bytes (at least a row); a smaller limit of its own stays."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    held = conf.get(key, None)
    if held is None or not held.rstrip("b").isdigit() or int(held.rstrip("b")) > BATCH:
        conf.set(key, f"{BATCH}b")
    return df
