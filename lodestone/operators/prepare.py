"""Benchmark sources to prepared documents and items, as expressions over nested rows."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import bounded
from .serving import slug, stable_uuid

#: Context passages of a snippet bundle and characters around an answer (fixed values).
CONTEXT_PASSAGES, WINDOW = 3, 80
NO_ANSWER = "No Answer Present."


def _filled(a: Column, skip: str) -> Column:
    return F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: (x != "") & (x != skip))


def snippet_answer(well_formed: Column, answers: Column) -> Column:
    """struct(text, kind): the first well-formed answer, else the first real one."""
    a, b = F.try_element_at(_filled(well_formed, "[]"), F.lit(1)), F.try_element_at(_filled(answers, NO_ANSWER), F.lit(1))
    return F.struct(F.coalesce(a, b, F.lit("")).alias("text"), F.when(a.isNotNull(), "well_formed_answer").when(b.isNotNull(), "short_answer").otherwise("missing").alias("kind"))


def _sections(passages: Column, name: str) -> Column:
    def one(p: Column, i: Column) -> Column:
        url = F.when(F.coalesce(p["url"], F.lit("")) != "", F.concat(F.lit("\n\nSource URL: "), p["url"])).otherwise("")
        return F.concat(F.lit(f"\n\n## {name} Passage "), (i + 1).cast("string"), url, F.lit("\n\n"), p["text"])

    return F.array_join(F.transform(passages, one), "")


def snippet_bundles(rows: DataFrame) -> DataFrame:
    """Rows (query_id, query, well_formed, answers, passages array<struct<text,url,selected>>) with a question, an answer
    and a selected passage, as one document and one item each."""
    texts = F.filter(F.transform("passages", lambda p: F.struct(F.trim(p["text"]).alias("text"), p["url"].alias("url"), p["selected"].alias("selected"))), lambda p: p["text"] != "")
    d = rows.withColumn("p", texts).withColumn("answer", snippet_answer(F.col("well_formed"), F.col("answers")))
    d = d.withColumn("chosen", F.filter("p", lambda x: x["selected"] == 1)).withColumn("around", F.slice(F.filter("p", lambda x: x["selected"] != 1), 1, CONTEXT_PASSAGES))
    d = d.where((F.trim("query") != "") & (F.col("answer.text") != "") & (F.size("chosen") > 0))
    title = F.concat(F.lit("MS MARCO Snippet Bundle "), F.col("query_id").cast("string"))
    return d.select(
        F.col("query_id").alias("source_document_id"),
        slug(F.concat(F.lit("msmarco-"), F.col("query_id").cast("string")), ".md").alias("file_name"),
        F.concat(F.lit("# "), title, _sections(F.col("chosen"), "Selected"), _sections(F.col("around"), "Context"), F.lit("\n")).alias("content"),
        stable_uuid(F.concat_ws("::", F.lit("msmarco"), F.col("query_id").cast("string"), "query")).alias("item_id"),
        F.col("query").alias("query_text"),
        F.col("answer.text").alias("answer_text"),
        F.col("answer.kind").alias("answer_type"),
        F.size("chosen").alias("selected_passages"),
        F.size("around").alias("context_passages"),
    )


def voted_answer(answers: Column) -> Column:
    """The (text, start) most annotators gave: ties to the earliest start, then the shorter text."""
    good = F.filter(answers, lambda a: (F.coalesce(a["text"], F.lit("")) != "") & (a["start"] >= 0))
    ranked = F.transform(good, lambda a: F.struct((-F.size(F.filter(good, lambda b: (b["text"] == a["text"]) & (b["start"] == a["start"])))).alias("v"), a["start"].alias("start"), F.length(a["text"]).alias("n"), a["text"].alias("text")))
    return F.array_min(ranked)


def evidence_window(context: Column, answer: Column, start: Column, window: int = WINDOW) -> Column:
    """The answer with so many characters on either side, trimmed; the answer itself if it is not inside."""
    end = F.least(F.length(context), start + F.length(answer))
    a, b = F.greatest(start - window, F.lit(0)), F.least(end + window, F.length(context))
    return F.when((start >= 0) & (start < F.length(context)) & (end > start), F.trim(F.substring(context, a + 1, b - a))).otherwise(answer)


def reading_items(paragraphs: DataFrame) -> DataFrame:
    """Questions of paragraphs (article_id, paragraph_id, context, qas array<struct<id,question,answers>>) with a voted answer."""
    q = paragraphs.select("article_id", "paragraph_id", "context", F.posexplode("qas").alias("question_index", "qa")).withColumn("a", voted_answer(F.col("qa.answers")))
    q = q.where(F.col("a").isNotNull() & (F.trim("qa.question") != ""))
    return q.select(
        F.col("article_id").alias("source_document_id"),
        "paragraph_id",
        "question_index",
        F.col("qa.question").alias("query_text"),
        F.col("a.text").alias("answer_text"),
        F.col("a.start").alias("answer_start"),
        evidence_window(F.col("context"), F.col("a.text"), F.col("a.start")).alias("evidence"),
    )


def newlines(c: Column) -> Column:
    """Line ends as single newlines, no blanks before them, at most one blank line, trimmed."""
    t = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def paper_markdown(title: Column, abstract: Column, sections: Column) -> Column:
    """A paper as markdown: title, abstract, and the sections (array of name, text) that have text."""
    filled = F.filter(sections, lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != "")
    body = F.array_join(F.transform(filled, lambda s: F.concat(F.lit("\n\n## "), F.coalesce(F.nullif(F.trim(s["name"]), F.lit("")), F.lit("Section")), F.lit("\n\n"), F.trim(s["text"]))), "")
    head = F.when(F.trim(F.coalesce(abstract, F.lit(""))) != "", F.concat(F.lit("\n\n## Abstract\n\n"), F.trim(abstract))).otherwise("")
    return F.concat(newlines(F.concat(F.lit("# "), F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("Untitled Paper")), head, body)), F.lit("\n"))


#: Tags that break a rendered token stream into paragraphs (fixed values).
BREAKS = "P DIV TR LI UL OL TABLE TBODY THEAD TD TH DD DT SECTION ARTICLE H1 H2 H3 H4 H5 H6 BR HR".split()


def rendered_tokens(tokens: Column) -> Column:
    """Text of a token stream (array of token, is_html): words by single spaces, paragraphs at block tags, punctuation
    moved to its word."""
    tag = lambda t: F.upper(F.regexp_extract(F.trim(t), r"^<\s*/?\s*([A-Za-z0-9]+)", 1))
    parts = F.transform(tokens, lambda t: F.when(t["is_html"], F.when(tag(t["token"]).isin(BREAKS), "\n\n").otherwise("")).otherwise(F.trim(t["token"])))
    t = F.array_join(F.filter(parts, lambda x: x != ""), " ")
    t = newlines(F.regexp_replace(t, r" *(?:\n\n *)+", "\n\n"))
    for pattern, to in ((r"[ \t]+([,.;:!?%)\]}])", "$1"), (r"([(\[{])\s+", "$1"), (r"\s+([’'])\s*", "$1"), (r"([A-Za-z])\s+([’']s\b)", "$1$2"), (r" {2,}", " ")):
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)


def first_acceptable(answers: Column, longest: int = 240) -> Column:
    """The first annotator's answer (unanswerable, yes_no, spans, evidence, text) that can be used: struct(text, evidence,
    kind), null if none can."""
    clean = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    usable = F.filter(
        answers,
        lambda a: ~F.coalesce(a["unanswerable"], F.lit(False)) & a["yes_no"].isNull() & ((F.size(clean(a["spans"])) > 0) | (F.size(clean(a["evidence"])) > 0)) & (F.length(F.coalesce(a["text"], F.lit(""))) <= longest),
    )
    shaped = F.transform(
        usable,
        lambda a: F.struct(
            F.coalesce(a["text"], F.lit("")).alias("text"),
            F.when(F.size(clean(a["spans"])) > 0, clean(a["spans"])).otherwise(clean(a["evidence"])).alias("evidence"),
            F.when(F.size(clean(a["spans"])) > 0, "extractive").otherwise("evidence_only").alias("kind"),
        ),
    )
    return F.try_element_at(shaped, F.lit(1))


def token_window(tokens: Column, first: Column, last: Column, around: int = 48) -> Column:
    """Tokens of an answer [first, last) with so many on either side, clamped to the stream."""
    a = F.greatest(first - around, F.lit(0))
    return F.slice(tokens, a + 1, F.greatest(F.least(last + around, F.size(tokens)) - a, F.lit(0)))


#: Documents that a question keeps when none is marked, and what stands for a word between Latin words (fixed values).
FIRST_DOCUMENTS, LATIN_TOKEN = 3, "^[A-Za-z0-9][A-Za-z0-9._:/+%-]*$"


def marked_documents(documents: Column, answer_indexes: Column) -> Column:
    """Of a question's documents (array of struct with is_selected) those marked or named by index (from 0), in order; the
    first FIRST_DOCUMENTS if there is none. Null documents are left out, but count for the indexes."""
    held = F.coalesce(answer_indexes, F.array().cast("array<int>"))
    marks = F.transform(documents, lambda d, i: F.struct(d.alias("d"), (F.coalesce(d["is_selected"], F.lit(False)) | F.coalesce(F.array_contains(held, i), F.lit(False))).alias("m")))
    chosen = F.filter(marks, lambda x: x["m"])
    return F.filter(F.transform(F.when(F.size(chosen) > 0, chosen).otherwise(F.slice(marks, 1, FIRST_DOCUMENTS)), lambda x: x["d"]), lambda d: d.isNotNull())


def segmented_text(tokens: Column) -> Column:
    """Text of segmented tokens: a space between two Latin tokens and nowhere else (Han and punctuation stand close)."""
    t = F.filter(F.transform(tokens, lambda x: F.trim(x)), lambda x: x != "")
    latin = lambda x: x.rlike(LATIN_TOKEN)
    before = F.concat(F.array(F.lit("")), t)  # one longer: the last pair has no token and is left out
    spaced = F.zip_with(before, t, lambda p, x: F.when(latin(p) & latin(x), F.concat(F.lit(" "), x)).otherwise(x))
    return F.array_join(spaced, "")


#: Subsets of the table question benchmark with their files; keys that may hold an answer's, a text's or an evidence's
#: text, in the order they are tried (fixed values).
SUBSETS = {"feta": "bench_feta_qa.json", "fin": "bench_fin_qa.json", "nq": "bench_nq_qa.json", "paper_tab": "bench_paper_tab_qa.json", "paper_text": "bench_paper_text_qa.json", "tat": "bench_tat_qa.json"}
ANSWER_KEYS = ["answer", "str_answer", "short_answer", "long_answer", "exe_answer"]
ENTRY_ANSWER_KEYS = ["answer", "short_answer", "long_answer"]
TEXT_KEYS = ["text", "paragraph", "content", "value", "sentence"]
EVIDENCE_KEYS = ["highlighted_evidence", "raw_evidence", "facts", "table_1", "table_2", "table_3", "table_4", "table", "table_array", "pre_text", "post_text", "context", "value"]


def subset_names(raw: str) -> list[str]:
    """Subsets of a comma-separated list; none, or one that is not known, is an error."""
    names = [n for n in (part.strip() for part in raw.split(",")) if n]
    unknown = sorted(set(names) - set(SUBSETS))
    if unknown or not names:
        raise ValueError(f"unknown subsets: {', '.join(unknown)}" if unknown else "no subset is named")
    return names


def flat(v) -> str:
    """Any JSON value as one text: lists by lines, objects by the first text key they have."""
    if isinstance(v, list):
        return "\n".join(t for t in map(flat, v) if t)
    if isinstance(v, dict):
        return next((flat(v[k]) for k in TEXT_KEYS if k in v), "")
    return "" if v is None else str(v).strip()


def _leaves(v) -> list[str]:
    """Texts of an evidence value, depth first; objects by EVIDENCE_KEYS, else as one text."""
    if isinstance(v, list):
        return [t for x in v for t in _leaves(x)]
    held = [t for k in EVIDENCE_KEYS if k in v for t in _leaves(v[k])] if isinstance(v, dict) else []
    return held or [t for t in (flat(v),) if t]


def entry_texts(entry: dict) -> tuple[str, str, str]:
    """Question, short answer and evidence lines (each once) of a benchmark entry."""
    a = entry.get("answers")
    rows = [r.get("answer") for r in a if isinstance(r, dict)] if isinstance(a, list) else [a.get(k) for k in ANSWER_KEYS] if isinstance(a, dict) else []
    answers = (t for t in map(flat, [*rows, *(entry.get(k) for k in ENTRY_ANSWER_KEYS)]) if t)
    evidence = next((e for e in (_leaves(entry.get(k)) for k in ("evidence", "facts", "context")) if e), [])
    lines = dict.fromkeys(t for t in (" ".join(e.split()) for e in evidence) if t)
    return flat(entry.get("question")), next(answers, ""), "\n".join(lines)


def table_question_rows(entries: DataFrame) -> DataFrame:
    """entries (subset, document_id, source_file, item_index, entry as JSON) to rows with question, answer and evidence.

    JSON of any nesting is walked where it is read, without a shuffle; an entry that is no JSON object is an error.
    """
    kept = ["subset", "document_id", "source_file", "item_index"]

    def run(batches):
        for b in batches:
            texts = [entry_texts(json.loads(e)) for e in b.column("entry").to_pylist()]
            made = [pa.array([t[i] for t in texts], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *made], [*kept, "question", "answer", "evidence"])

    typed = entries.select("subset", F.col("document_id").cast("string"), "source_file", F.col("item_index").cast("long"), "entry")
    return bounded(typed).mapInArrow(run, "subset string, document_id string, source_file string, item_index long, question string, answer string, evidence string")
