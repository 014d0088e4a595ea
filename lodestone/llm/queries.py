"""The registered queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, html_extract, packing, phrases, pii, quality, runs, secrets, sharding, simhash, token_shards, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_flat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op3_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards by minimax contiguous partition."""
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the 50k byte-level vocabulary."""
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op5_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document by the patterns and by the test battery."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op6_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return ann.search(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document, by rules learned from labels."""
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written as fixed-stride shards in a keyed order; the index of every sequence."""
    return token_shards.materialise(_table(spark, sf_dir, "documents"))


def op9_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, plain and disguised."""
    return pii.scan(_table(spark, sf_dir, "documents"))


def op10_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_prefix_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language, from phrases grown over all documents."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels with swapped names of groups."""
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, by block matching."""
    return runs.periodic_runs(_table(spark, sf_dir, "documents"), plant=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_flat_blocks": op2_flat_blocks,
    "op3_minimax_sharding": op3_minimax_sharding,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_randomness_battery": op5_randomness_battery,
    "op6_kmeans_tree": op6_kmeans_tree,
    "op7_decision_list": op7_decision_list,
    "op8_training_order": op8_training_order,
    "op9_deobfuscated_pii": op9_deobfuscated_pii,
    "op10_linear_grouping": op10_linear_grouping,
    "op11_prefix_growth": op11_prefix_growth,
    "op12_counterfactual": op12_counterfactual,
    "op13_periodic_runs": op13_periodic_runs,
}

_PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
  FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
), sized AS (
  SELECT lang, w, unnest(range(1, 5)) AS k FROM words WHERE len(w) > 0
), placed AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized WHERE len(w) >= k
), freq AS MATERIALIZED (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*)::HUGEINT AS f FROM placed GROUP BY ALL HAVING count(*) >= 30
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), candidates AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE k > 1
), cuts AS (
  SELECT lang, phrase, a, w, unnest(range(1, k)) AS cut FROM candidates
), cut_scores AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM cuts c
  JOIN freq x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN freq y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')
), lowest AS (
  SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_sized AS (
  SELECT lang, a, w, unnest(range(2, k)) AS m FROM candidates WHERE k > 2
), inner_placed AS (
  SELECT lang, a, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM inner_sized
), around AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS a FROM inner_placed GROUP BY ALL
), ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, b.score
  FROM lowest b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.a IS NULL OR 100 * o.a < 80 * b.a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

#: Where SQL can express the operator; its numbers and patterns are the fixed values of the query.
ORACLES: dict[str, str] = {"op11_prefix_growth": _PHRASES}
