"""Queries over parsing, chunking and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import artifacts, chunking, parsing
from ..sources import adapters
from .catalog import register


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.spread(adapters.table(spark, sf, "documents")).select(F.col("doc_id").alias("document_id"), F.concat("doc_id", F.lit(".txt")).alias("file_name"), F.col("text").cast("binary").alias("content"))


@register("parse_txt", "SELECT doc_id AS document_id, 0 AS start_offset, length(trim(text, chr(10) || chr(9) || chr(13) || ' ')) AS end_offset FROM documents WHERE trim(text, chr(10) || chr(9) || chr(13) || ' ') <> ''")
def parse_txt(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.parse_files(_files(spark, sf)).where("error is null").select("document_id", "start_offset", "end_offset")


@register("parse_html_blocks")
def parse_html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of every page by the tag rules; tested on hand-made pages."""
    pages = adapters.spread(adapters.table(spark, sf, "pages")).select(F.col("page_id").alias("document_id"), F.lit("page.html").alias("file_name"), F.col("html").cast("binary").alias("content"))
    return parsing.parse_files(pages).drop("error")


_GROUPED = "SELECT doc_id AS document_id, (i // 4)::INT AS section_index, count(*) AS lines, md5(string_agg(line, chr(10) || chr(10) ORDER BY i)) AS text_md5 FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)) GROUP BY ALL"


@register("text_sections", _GROUPED)
def text_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Parents of four lines each, by array functions alone."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    d = adapters.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), lines.alias("l")).where(F.size("l") > 0)
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 4).cast("int")), lambda i: F.slice(F.col("l"), i * 4 + 1, F.lit(4)))
    g = d.select("document_id", F.posexplode(groups).alias("section_index", "g"))
    return g.select("document_id", "section_index", F.size("g").cast("long").alias("lines"), F.md5(F.array_join("g", "\n\n")).alias("text_md5"))


@register("chunk_tree")
def chunk_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk trees of all documents; offsets are tested to slice back to the content."""
    return chunking.chunk_files(_files(spark, sf)).drop("display_text")


@register("pdf_markdown_cleanup", "SELECT conv_id, turn, length(text) AS n FROM (SELECT conv_id, turn, trim(text) AS text FROM conversations)")
def pdf_markdown_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """Page labels and rules put around each text are taken out again."""
    dirty = F.concat(F.lit("Page 3 of 9\n"), "text", F.lit("\n\n\n\n---\npage 4\n"))
    return adapters.table(spark, sf, "conversations").select("conv_id", "turn", F.length(text.clean_pdf_markdown(dirty)).cast("long").alias("n"))


@register("answer_blocks", "SELECT conv_id, turn, i::INT AS i, trim(text) AS text, CASE WHEN i = 0 THEN 'C1,C2' ELSE 'C3' END AS labels FROM (SELECT *, unnest(range(2)) AS i FROM conversations)")
def answer_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Citation marks of answers: two paragraphs made from each turn."""
    marked = F.concat("text", F.lit(" [[C1,C2]] [[C1]]\n\n"), "text", F.lit(" [[C3]]"))
    c = adapters.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(text.answer_blocks(marked)).alias("i", "b"))
    return c.select("conv_id", "turn", "i", F.col("b.text").alias("text"), F.array_join("b.labels", ",").alias("labels"))


@register(
    "layout_artifacts",
    "SELECT document_id, (i - 1)::INT AS block_index, 'L' || (i - 1) AS heading, md5(trim(l[i])) AS content_md5, ((i - 1) // 10 + 1)::INT AS page_start, ((i - 1) // 10 + 1)::INT AS page_end, 1 AS boxes, (i - 1)::DOUBLE AS top "
    "FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id AS document_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#')) AS l FROM documents))",
)
def layout_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks with pages and boxes, rebuilt from JSON artifacts; the layout is made of the lines of every document."""
    lines = F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))
    d = adapters.spread(adapters.table(spark, sf, "documents")).select(F.col("doc_id").alias("document_id"), lines.alias("l")).where(F.size("l") > 0)
    markdown = F.array_join(F.transform("l", lambda x, i: F.concat(F.lit("# L"), i, F.lit("\n"), x)), "\n")
    page = lambda i: F.floor(i / 10).cast("int") + 1
    box = lambda i: F.struct(page(i).alias("page"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), i.cast("double").alias("y1"))
    element = F.transform("l", lambda x, i: F.struct(F.lit("paragraph").alias("type"), x.alias("content"), page(i).alias("page"), F.array(box(i)).alias("bboxes")))
    payload = F.to_json(F.struct(F.array(F.struct(F.transform(F.array(element), lambda e: e)[0].alias("kids"))).alias("pages")))
    files = d.select("document_id", F.concat("document_id", F.lit(".pdf")).alias("file_name"), markdown.cast("binary").alias("content"), payload.alias("payload"))
    rows = artifacts.rebuild(artifacts.make(files, "opendataloader"))
    return rows.select("document_id", "block_index", "heading", F.md5("content").alias("content_md5"), "page_start", "page_end", F.size("regions").alias("boxes"), F.col("regions")[0]["top"].alias("top"))
