"""Queries over text functions, documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import documents as ops
from ..operators import recall
from ..sources import adapters
from .catalog import register

_T = adapters.table
_TOKENS = "regexp_extract_all(replace(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), 'ß', 'ss'), '([A-Za-z0-9][A-Za-z0-9._/-]*|[㐀-䶿一-鿿]+)')"


def _distinct(expr: str) -> str:
    """Ordered distinct elements in SQL."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


@register("query_tokens", f"SELECT item_id, array_to_string({_distinct('t')}, ' ') AS tokens, len({_distinct('t')})::INT AS n FROM (SELECT item_id, {_TOKENS.format('text')} AS t FROM benchmark)")
def query_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = _T(spark, sf, "benchmark").select("item_id", text.query_tokens(F.col("text")).alias("t"))
    return t.select("item_id", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n"))


@register("query_language", "SELECT CASE WHEN regexp_matches(text, '[㐀-䶿一-鿿]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[㐀-䶿一-鿿]') THEN 'zh-TW' ELSE 'en' END AS language, count(*) AS n FROM (SELECT text FROM conversations UNION ALL SELECT '摘要 ' || text FROM conversations UNION ALL SELECT '摘要') GROUP BY ALL")
def query_language(spark: SparkSession, sf: str) -> DataFrame:
    c = _T(spark, sf, "conversations").select("text")
    rows = c.union(c.select(F.concat(F.lit("摘要 "), "text"))).union(spark.createDataFrame([("摘要",)], "text string"))
    return rows.groupBy(text.language(F.col("text")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@register("normalize_query", "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 120) AS preview FROM conversations")
def normalize_query(spark: SparkSession, sf: str) -> DataFrame:
    return _T(spark, sf, "conversations").select("conv_id", "turn", text.squeeze(F.col("text")).alias("q"), text.preview(F.col("text")).alias("preview"))


@register("embedding_input", adapters.sql("SELECT chunk_id, md5(trim(heading) || chr(10) || chr(10) || trim(content)) AS input_md5 FROM children"))
def embedding_input(spark: SparkSession, sf: str) -> DataFrame:
    kids = adapters.children(adapters.documents(spark, sf))
    return kids.select("chunk_id", F.md5(text.embedding_input(F.col("heading"), F.col("content"))).alias("input_md5"))


@register("document_handles", "SELECT doc_id, 'doc_' || rtrim(replace(replace(base64(encode(doc_id::VARCHAR)), '+', '-'), '/', '_'), '=') AS handle, doc_id::VARCHAR AS back FROM documents")
def document_handles(spark: SparkSession, sf: str) -> DataFrame:
    h = _T(spark, sf, "documents").select("doc_id", text.handle(F.col("doc_id")).alias("handle"))
    return h.withColumn("back", text.from_handle(F.col("handle")))


@register("ordered_distinct_texts", "SELECT conv_id, array_to_string(" + _distinct("l") + ", '|') AS items FROM (SELECT conv_id, list_filter(list_transform(list(role || text ORDER BY turn), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations GROUP BY ALL)")
def ordered_distinct_texts(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct("turn", F.concat("role", "text").alias("x"))
    g = _T(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("l"))
    return g.select("conv_id", F.array_join(text.ordered_distinct(F.transform("l", lambda s: s["x"])), "|").alias("items"))


_NAMES = "SELECT document_id, trim(regexp_replace(regexp_replace(replace(lower(regexp_replace(file_name, '\\.[^./]+$', '')), 'ß', 'ss'), '[_\\-./()\\[\\]{}]+', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM docs"


@register("document_names", adapters.sql(_NAMES))
def document_names(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.documents(spark, sf).select("document_id", text.document_name(F.col("file_name")).alias("name"))


@register("name_token_frequency", adapters.sql("SELECT token, count(*) AS n FROM (SELECT DISTINCT document_id, unnest(string_split(name, ' ')) AS token FROM names) GROUP BY ALL", f"names AS ({_NAMES})"))
def name_token_frequency(spark: SparkSession, sf: str) -> DataFrame:
    names = document_names(spark, sf).select(F.explode(F.array_distinct(F.split("name", " "))).alias("token"))
    return names.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@register("unique_segments", adapters.sql("SELECT token, min(document_id) AS owner FROM (SELECT document_id, unnest(string_split(name, ' ')) AS token FROM names) GROUP BY token HAVING count(DISTINCT document_id) = 1", f"names AS ({_NAMES})"))
def unique_segments(spark: SparkSession, sf: str) -> DataFrame:
    seg = document_names(spark, sf).select("document_id", F.explode(F.split("name", " ")).alias("token"))
    return seg.groupBy("token").agg(F.countDistinct("document_id").alias("n"), F.min("document_id").alias("owner")).where("n = 1").drop("n")


@register("sentence_split", "SELECT doc_id, len(l)::INT AS sentences, length(l[1]) AS first_chars FROM (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS l FROM documents WHERE lang = 'en')")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    s = _T(spark, sf, "documents").where("lang = 'en'").select("doc_id", text.sentences(F.trim("text"), F.lit("en")).alias("l"))
    return s.select("doc_id", F.size("l").alias("sentences"), F.length(F.element_at("l", 1)).cast("long").alias("first_chars"))


@register("turn_overlap", "SELECT a.conv_id, a.turn, round(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) END, 6) AS overlap FROM x a JOIN x b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1".replace("FROM x a", "FROM (SELECT conv_id, turn, list_distinct(" + _TOKENS.format("text") + ") AS t FROM conversations) a").replace("JOIN x b", "JOIN (SELECT conv_id, turn, list_distinct(" + _TOKENS.format("text") + ") AS t FROM conversations) b"))
def turn_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Jaccard overlap of each turn's tokens with the next turn's."""
    t = _T(spark, sf, "conversations").select("conv_id", "turn", text.query_tokens(F.col("text")).alias("t"))
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return t.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(scoring.jaccard(F.col("t"), F.col("u")), 6).alias("overlap"))


@register("stable_fraction", "SELECT doc_id, round(('0x' || substr(sha256(lang || chr(0) || doc_id::VARCHAR || chr(0) || text), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615::DOUBLE, 9) AS fraction FROM documents")
def stable_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return _T(spark, sf, "documents").select("doc_id", F.round(scoring.stable_fraction(F.col("lang"), F.col("doc_id").cast("string"), F.col("text")), 9).alias("fraction"))


_EMBED = """
WITH b AS (SELECT item_id, unnest(range(16)) AS i, text FROM benchmark),
n AS (SELECT item_id, i, ('0x' || substr(sha256(text || chr(0) || (i // 8)::VARCHAR), (8 * (i % 8) + 1)::INT, 8))::UBIGINT::DOUBLE / 4294967295.0::DOUBLE * 2 - 1 AS x FROM b)
SELECT item_id, i::INT AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 9) AS x FROM n
"""


@register("deterministic_embedding", _EMBED)
def deterministic_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen dimensions of the hash embedding, unpivoted."""
    e = _T(spark, sf, "benchmark").select("item_id", F.posexplode(scoring.deterministic_embedding(F.col("text"), 16)).alias("i", "x"))
    return e.withColumn("x", F.round("x", 9))


@register("cosine_pairs", "SELECT a.vec_id, round(1 - list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) + 0.0 AS cosine, round(least(greatest((2 - list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2, 0), 1), 9) AS confidence FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = _T(spark, sf, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    s = scoring.cosine_similarity(F.col("embedding"), F.col("other"))
    return e.join(other, "vec_id").select("vec_id", (F.round(s, 9) + 0.0).alias("cosine"), F.round(scoring.confidence(s), 9).alias("confidence"))


@register("prototype_labels", "SELECT vec_id, label, round(best, 6) + 0.0 AS best FROM (SELECT q.vec_id, p.label, max(1 - list_cosine_distance(q.embedding::DOUBLE[], p.embedding::DOUBLE[])) AS best FROM embeddings q, (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3) p GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(best, 12) DESC, label) <= 2")
def prototype_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Best and second label of every vector by the nearest of three prototypes a label (30 rows, fixed)."""
    e = _T(spark, sf, "embeddings")
    protos = recall.ranked(e, ["label"], ["vec_id"], "rn", 3).select("label", F.col("embedding").alias("p"))
    scored = e.drop("label").crossJoin(F.broadcast(protos)).groupBy("vec_id", "label").agg(F.max(scoring.cosine_similarity(F.col("embedding"), F.col("p"))).alias("best"))
    top = recall.ranked(scored, ["vec_id"], [F.desc(F.round("best", 12)), "label"], "rn", 2)
    return top.select("vec_id", "label", (F.round("best", 6) + 0.0).alias("best"))


@register("chunk_summary", adapters.sql("SELECT d.document_id, count(DISTINCT c.parent_id) AS parents, count(c.chunk_id) AS children FROM docs d LEFT JOIN children c USING (document_id) GROUP BY ALL"))
def chunk_summary(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapters.documents(spark, sf)
    return ops.chunk_summary(adapters.children(docs), docs)


@register("chunk_kind_pivot", adapters.sql("SELECT area_id, count(*) FILTER (structure_kind = 'text') AS text, count(*) FILTER (structure_kind = 'table') AS \"table\" FROM children GROUP BY ALL"))
def chunk_kind_pivot(spark: SparkSession, sf: str) -> DataFrame:
    kids = adapters.children(adapters.documents(spark, sf))
    return kids.groupBy("area_id").pivot("structure_kind", ["text", "table"]).count().fillna(0)


_DIAG = """
WITH_SECTIONS AS (SELECT document_id, section_index, count(DISTINCT structure_kind) AS n, list(structure_kind ORDER BY child_index) AS kinds FROM children GROUP BY ALL)
""".replace("WITH_SECTIONS", "sections")


@register("chunking_diagnostics", adapters.sql("SELECT document_id, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END)::BIGINT AS mixed_sections, sum(CASE WHEN list_filter(kinds, lambda k, i: i = 1 OR kinds[i - 1] <> k) = ['text', 'table', 'text'] THEN 1 ELSE 0 END)::BIGINT AS table_clusters FROM sections GROUP BY ALL", _DIAG))
def chunking_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return ops.chunking_diagnostics(adapters.children(adapters.documents(spark, sf)))


_RUNS = """
islands AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY child_index) - row_number() OVER (PARTITION BY parent_id, structure_kind ORDER BY child_index) AS island FROM children)
"""


@register("merged_runs", adapters.sql("SELECT document_id, parent_id, structure_kind, min(child_index) AS first_child, count(*) AS n, md5(CASE WHEN structure_kind = 'table' THEN string_agg(trim(content), chr(10) ORDER BY child_index) ELSE string_agg(trim(content), chr(10) || chr(10) ORDER BY child_index) END) AS text_md5 FROM islands GROUP BY document_id, parent_id, structure_kind, island", _RUNS))
def merged_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = ops.merged_runs(adapters.children(adapters.documents(spark, sf)))
    return runs.select("document_id", "parent_id", "structure_kind", "first_child", "n", F.md5("text").alias("text_md5"))


@register("document_search", adapters.sql("SELECT c.document_id, d.file_name, c.position, substr(c.content, 1, 240) AS excerpt FROM children c JOIN docs d USING (document_id) WHERE c.status = 'ready' AND c.content ILIKE '%license%' ORDER BY d.file_name, c.position LIMIT 10"))
def document_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = adapters.documents(spark, sf)
    return ops.search(adapters.children(docs), docs, "license")


@register("document_preview", adapters.sql("SELECT document_id, count(*) AS chunks, min(start_offset) AS first_offset, max(end_offset) AS last_offset, array_to_string(list(position ORDER BY section_index, child_index), ',') AS positions FROM children WHERE status = 'ready' GROUP BY ALL"))
def document_preview(spark: SparkSession, sf: str) -> DataFrame:
    kids = adapters.children(adapters.documents(spark, sf)).where("status = 'ready'")
    g = kids.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.min("start_offset").alias("first_offset"), F.max("end_offset").alias("last_offset"), F.sort_array(F.collect_list(F.struct("section_index", "child_index", "position"))).alias("p"))
    return g.select("document_id", "chunks", "first_offset", "last_offset", F.array_join(F.transform("p", lambda x: x["position"].cast("string")), ",").alias("positions"))


@register("ready_documents", adapters.sql("SELECT area_id, document_id, file_name, row_number() OVER (PARTITION BY area_id ORDER BY document_id, file_name) AS place FROM docs WHERE status = 'ready'"))
def ready_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = adapters.documents(spark, sf).where("status = 'ready'")
    return recall.numbered(d, ["area_id"], "document_id", ["file_name"], "place").select("area_id", "document_id", "file_name", "place")


@register("sql_gate", adapters.sql("SELECT area_id, count(*) AS n FROM children WHERE status = 'ready' AND area_id IN ('src0', 'src3') AND document_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144) GROUP BY ALL"))
def sql_gate(spark: SparkSession, sf: str) -> DataFrame:
    kids = recall.gate(adapters.children(adapters.documents(spark, sf)), ["src0", "src3"], [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])
    return kids.groupBy("area_id").agg(F.count(F.lit(1)).alias("n"))


@register("offset_round_trip", adapters.sql("SELECT count(*) AS chunks, count(*) FILTER (substr(d.display_text, c.start_offset + 1, c.end_offset - c.start_offset) = c.content) AS exact FROM children c JOIN docs d USING (document_id)"))
def offset_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Offsets slice back to the content of every chunk."""
    docs = adapters.documents(spark, sf)
    j = adapters.children(docs).join(docs.select("document_id", "display_text"), "document_id")
    same = F.substring("display_text", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")) == F.col("content")
    return j.agg(F.count(F.lit(1)).alias("chunks"), F.count(F.when(same, 1)).alias("exact"))


@register("document_recall", adapters.sql("SELECT query_id, document_id, score, fts_rank FROM (SELECT t.query_id, d.document_id, sum((length(d.low) - length(replace(d.low, t.token, ''))) // length(t.token))::INT AS score FROM (SELECT document_id, lower(display_text) AS low FROM docs WHERE status = 'ready') d, (SELECT query_id, unnest(list_filter(string_split_regex(lower(query_text), '\\s+'), lambda x: x <> '')) AS token FROM questions) t WHERE contains(d.low, t.token) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) <= 6".replace("SELECT query_id, document_id, score, fts_rank FROM", "SELECT query_id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS fts_rank FROM").replace("QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) <= 6", "QUALIFY fts_rank <= 6")))
def document_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Text recall at document level over whole texts."""
    syn = adapters.documents(spark, sf).where("status = 'ready'").select("document_id", F.col("display_text").alias("synopsis"))
    return recall.text_recall(syn, adapters.questions(spark, sf), 6, "document_id", "synopsis")


@register("section_recall", adapters.sql("SELECT query_id, parent_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS fts_rank FROM (SELECT t.query_id, d.parent_id, sum((length(d.low) - length(replace(d.low, t.token, ''))) // length(t.token))::INT AS score FROM (SELECT parent_id, lower(string_agg(content, chr(10) ORDER BY child_index)) AS low FROM children WHERE status = 'ready' GROUP BY ALL) d, (SELECT query_id, unnest(list_filter(string_split_regex(lower(query_text), '\\s+'), lambda x: x <> '')) AS token FROM questions) t WHERE contains(d.low, t.token) GROUP BY ALL) QUALIFY fts_rank <= 10"))
def section_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Text recall at parent level."""
    rows = recall.gate(adapters.parents(adapters.documents(spark, sf))).select("parent_id", F.col("content").alias("synopsis"))
    return recall.text_recall(rows, adapters.questions(spark, sf), 10, "parent_id", "synopsis")


@register("set_operations", adapters.sql("SELECT 'shared' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'missing', count(*) FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION SELECT doc_id FROM labels)"))
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Shared, missing and united ids of two sets."""
    a, b = _T(spark, sf, "documents").where("doc_id % 2 = 0").select("doc_id"), _T(spark, sf, "labels").select("doc_id")
    n = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n("shared", a.intersect(b)).union(n("missing", a.subtract(b))).union(n("either", a.union(b).distinct()))


@register("running_offsets", "SELECT conv_id, turn, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset FROM conversations")
def running_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where each block starts when a thread's blocks are joined by blank lines."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return _T(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0)).alias("start_offset"))
