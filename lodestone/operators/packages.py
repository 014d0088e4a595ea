"""Benchmark packages from public summary sources, and the report of a benchmark run as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Items of a package, documents of a report item, claims of a summary, characters of a claim and of a quote (fixed values).
ITEMS, DOCUMENTS, CLAIMS, CLAIM_CHARS, QUOTE_CHARS = 10, 3, 2, 120, 240
#: What parts the documents of a report line, what stands for a line's end in it (fixed values).
PARTED, LINE_END = "|||||", "NEWLINE_CHAR"
#: Instruction before an article, questions that packages ask, axes of a comparison (fixed values).
INSTRUCTION = "在本任务中，您将获得一段文本，您的任务是生成该文本的摘要。"
ARTICLE_QUESTION = "請摘要這篇新聞的重點。"
REPORTS_QUESTION = "Summarize the common themes and key developments across these news reports."
COMPARE_QUESTION = "Compare the two travel entities based on the provided review summaries. Include the main strengths of each entity and any shared points."
COMPARE_AXES = ["entity A strengths", "entity B strengths", "shared points"]


def sentences(c: Column, han: bool) -> Column:
    """Trimmed sentences: Han ones without their marks, others with them."""
    parts = F.split(c, "[。！？]") if han else F.split(c, r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, text.strip), lambda s: s != "")


def claims(summary: Column, han: bool) -> Column:
    """The first two sentences of a summary, cut; of one without sentences what there is."""
    found = sentences(summary, han)
    held = F.when(F.size(found) > 0, F.slice(found, 1, CLAIMS)).otherwise(F.array(text.strip(summary)))
    return F.transform(held, lambda c: F.substring(c, 1, CLAIM_CHARS))


def first_items(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first ITEMS rows in order, with item_index from 1; so few that they are numbered in one task."""
    return rows.orderBy(*order).limit(ITEMS).withColumn("item_index", F.row_number().over(Window.orderBy(*order)))


def _quote(name: Column, body: Column) -> Column:
    return F.struct(name.alias("file_name"), F.substring(body, 1, QUOTE_CHARS).alias("quote"))


def _items(rows: DataFrame, source: str, task: str, language: str, question: Column, strategy: str | None, documents: Column, quotes: Column, answer: Column, headings: Column, points: Column) -> DataFrame:
    return rows.select(
        "item_index",
        F.concat(F.lit(f"{source}-"), F.col("item_index").cast("string")).alias("id"),
        F.lit(language).alias("language"),
        F.lit(task).alias("task_type"),
        question.alias("question"),
        F.lit(strategy).cast("string").alias("summary_strategy"),
        documents.alias("documents"),
        F.transform(documents, lambda d: d["file_name"]).alias("expected_document_names"),
        headings.alias("expected_section_headings"),
        points.alias("required_claims_or_axes"),
        quotes.alias("gold_span_refs"),
        answer.alias("reference_answer"),
    )


def _named(prefix: str, suffix: str = ".md", index: str = "item_index") -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.format_string("%02d", F.col(index)), F.lit(suffix))


def article_items(rows: DataFrame, order: list[str], source: str = "lcsts") -> DataFrame:
    """rows (article, summary): one Han article an item, without the instruction before it."""
    bare = F.when(F.startswith("article", F.lit(INSTRUCTION)), F.substring("article", len(INSTRUCTION) + 1, 2**31 - 1)).otherwise(F.col("article"))
    r = first_items(rows, order).withColumn("article", text.strip(bare))
    name = _named(f"{source}-article")
    document = F.array(F.struct(name.alias("file_name"), F.col("article").alias("content")))
    lead = F.coalesce(F.try_element_at(sentences(F.col("article"), True), F.lit(1)), F.lit(""))
    summary = F.col("summary")
    return _items(r, f"{source}-summary", "document_summary", "zh-TW", F.lit(ARTICLE_QUESTION), "document_overview", document, F.array(_quote(name, lead)), summary, F.array().cast("array<string>"), claims(summary, True))


def report_items(rows: DataFrame, order: list[str], source: str = "multinews") -> DataFrame:
    """rows (source, summary): a line of up to DOCUMENTS reports an item."""
    parts = F.filter(F.transform(F.split(F.replace(text.strip(F.col("source")), F.lit(LINE_END), F.lit("\n")), r"\|{5}"), text.strip), lambda p: p != "")
    r = first_items(rows, order).withColumn("parts", F.slice(parts, 1, DOCUMENTS)).withColumn("summary", text.strip(F.col("summary")))
    base = _named(source, "")
    documents = F.transform("parts", lambda p, i: F.struct(F.concat(base, F.lit("-doc-"), (i + 1).cast("string"), F.lit(".md")).alias("file_name"), p.alias("content")))
    quotes = F.transform(documents, lambda d: _quote(d["file_name"], F.coalesce(F.try_element_at(sentences(d["content"], False), F.lit(1)), F.lit(""))))
    summary = F.col("summary")
    return _items(r, f"{source}-summary", "document_summary", "en", F.lit(REPORTS_QUESTION), "multi_document_theme", documents, quotes, summary, F.array().cast("array<string>"), claims(summary, False))


def meeting_items(meetings: DataFrame, source: str = "qmsum") -> DataFrame:
    """meetings (place from 0, turns array<struct<speaker,content>>, topics array<struct<topic,span>>, queries
    array<struct<query,answer,span>>; spans are [first, last] turns from 1) to the first questions in order: quotes are the
    turn a span begins with and the next one of it, headings the topics with the same span."""
    asked = meetings.select("place", "turns", "topics", F.posexplode("queries").alias("query_place", "q"))
    r = first_items(asked, ["place", "query_place"]).withColumn("number", F.col("place") + 1)
    name = _named(f"{source}-meeting", index="number")
    transcript = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("### "), t["speaker"], F.lit("\n"), t["content"])), "\n\n")
    turn = lambda i: F.try_element_at("turns", i.cast("int"))["content"]
    first, last = F.col("q.span")[0], F.col("q.span")[1]
    spanned = F.col("q.span").isNotNull() & (F.size("q.span") > 0)
    quotes = F.when(spanned, F.array(_quote(name, turn(first)), _quote(name, turn(F.least(last, first + 1))))).otherwise(F.array(_quote(name, turn(F.lit(1)))))
    none = F.array().cast("array<string>")
    headings = F.when(spanned, F.transform(F.filter(F.coalesce("topics", F.array().cast("array<struct<topic:string,span:array<int>>>")), lambda t: t["span"] == F.col("q.span")), lambda t: F.coalesce(t["topic"], F.lit("meeting topic")))).otherwise(none)
    document = F.array(F.struct(name.alias("file_name"), transcript.alias("content")))
    return _items(r, f"{source}-summary", "document_summary", "en", F.col("q.query"), "section_focused", document, quotes, F.col("q.answer"), headings, claims(F.col("q.answer"), False))


def comparison_items(rows: DataFrame, order: list[str], source: str = "cocotrip") -> DataFrame:
    """rows (a, b, common: arrays of summaries of two entities and of both) to items that compare them."""
    r = first_items(rows, order)
    sides = [(_named(source, f"-entity-{x}.md"), x) for x in "ab"]
    documents = F.array(*[F.struct(n.alias("file_name"), F.concat(F.lit(f"# Entity {x.upper()}\n\n"), F.array_join(x, "\n\n")).alias("content")) for n, x in sides])
    answer = F.concat(F.lit("Entity A: "), F.col("a")[0], F.lit(" Entity B: "), F.col("b")[0], F.lit(" Shared points: "), F.col("common")[0])
    quotes = F.array(*[_quote(n, F.col(x)[0]) for n, x in sides])
    return _items(r, f"{source}-compare", "cross_document_compare", "en", F.lit(COMPARE_QUESTION), None, documents, quotes, answer, F.array().cast("array<string>"), claims(answer, False))


def write_package(items: DataFrame, path: str) -> None:
    """A package's questions and source documents as JSON lines under path; an earlier package there is replaced."""
    items.drop("documents").write.mode("overwrite").json(f"{path}/questions")
    items.select(F.explode("documents").alias("d")).select("d.*").dropDuplicates(["file_name"]).write.mode("overwrite").json(f"{path}/source_documents")


def shown_score(value: Column, status: Column) -> Column:
    """A score as a report shows it: its value, without one its status."""
    return F.coalesce(value.cast("string"), status)


def dataset_lines(scores: DataFrame) -> DataFrame:
    """scores (dataset, metric, value, status, partial) with the report's line of each dataset."""
    line = F.concat(F.lit("- `"), "dataset", F.lit("`: metric=`"), "metric", F.lit("` value=`"), shown_score(F.col("value"), F.col("status")), F.lit("` partial=`"), F.initcap(F.col("partial").cast("string")), F.lit("`"))
    return scores.withColumn("line", line)


def run_report(run: DataFrame, scores: DataFrame) -> DataFrame:
    """One row `report`: run (one row: name, version, items, workers, judge_failed, partial_items, summary_score,
    compare_score, deltas as JSON) and its datasets' scores as Markdown; datasets in order of their names.

    Datasets of a run are a handful: their lines are put into one text.
    """
    lines = dataset_lines(scores).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("dataset", "line"))), lambda r: r["line"]), "\n").alias("lines"))
    row = lambda label, c: F.concat(F.lit(f"- {label}: `"), F.coalesce(c.cast("string"), F.lit("")), F.lit("`"))
    parts = [
        F.lit("# Summary / Compare Benchmark\n"),
        F.concat(F.lit("- Benchmark: `"), "name", F.lit("` `"), "version", F.lit("`")),
        row("Dataset Count", F.col("n")),
        row("Item Count", F.col("items")),
        row("Summary Benchmark Score", F.col("summary_score")),
        row("Compare Benchmark Score", F.col("compare_score")),
        row("Parallel Workers", F.col("workers")),
        row("Judge Failed Count", F.col("judge_failed")),
        row("Partial Item Count", F.col("partial_items")),
        F.lit("\n## Per Dataset Scores\n"),
        F.when(F.col("n") > 0, F.col("lines")).otherwise("- 無"),
        F.lit("\n## Baseline Delta\n"),
        F.concat(F.lit("```json\n"), "deltas", F.lit("\n```")),
    ]
    return run.crossJoin(F.broadcast(lines)).select(F.concat_ws("\n", *parts).alias("report"))
