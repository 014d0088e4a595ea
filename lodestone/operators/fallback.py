"""Labels from a language model where rules and embeddings leave a question undecided.

Only undecided rows are asked about. The model must name one of the labels it is given; anything else, and an error that
does not pass, leaves the safe label with its reason.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scorers import asked

#: Labels with what they mean, the instruction, and the confidence where none can be read (fixed values).
TASK_TYPES = {
    "fact_lookup": "question asks for a specific fact, rule, definition, actor, number, or deadline",
    "document_summary": "question asks for a summary, overview, or synthesis of document content",
    "cross_document_compare": "question asks to compare or contrast multiple documents or viewpoints",
}
STRATEGIES = {
    "document_overview": "single-document overall summary of the whole document",
    "section_focused": "single-document summary focused on one section, part, or topical subsection",
    "multi_document_theme": "multi-document thematic synthesis across documents",
}
INSTRUCTION = "You are a strict routing classifier for a RAG system. Choose exactly one label from the provided label options. Do not rewrite the query. Do not infer from any hidden document content. Only use the query, language, and mention summary. Return JSON with keys `label`, `confidence`, and `reason`."
UNREAD_CONFIDENCE, LOW_CONFIDENCE, UNAVAILABLE = 0.7, "low_embedding_confidence", "llm_fallback_unavailable"
#: Mentions of a prompt (fixed value).
MENTIONS = 3

_ANSWER = T.StructType([T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType())])


def prompt(classifier: str, query: str, language: str, labels: dict[str, str], context: dict) -> tuple[str, str]:
    """Instruction and question of the model."""
    body = {"classifier_name": classifier, "query": query, "language": language, "labels": [{"label": k, "description": v} for k, v in labels.items()], "context": context}
    return INSTRUCTION, json.dumps(body, ensure_ascii=False, indent=2)


def read_confidence(value: object) -> float:
    """A confidence from 0 to 1, whatever the model wrote."""
    try:
        return max(0.0, min(1.0, float(value)))
    except (TypeError, ValueError):
        return UNREAD_CONFIDENCE


def read_answer(text: str, labels: list[str]) -> tuple[str, float] | None:
    """(label, confidence) of the model's JSON; None unless it names one of the labels."""
    got = json.loads(text or "{}")
    label = str(got.get("label", "")).strip() if isinstance(got, dict) else ""
    return (label, read_confidence(got.get("confidence"))) if label in labels else None


def _json_asked(call: Callable[[str, str], str], told: tuple[str, str], labels: list[str], tries: int, sleep: Callable[[float], None]) -> tuple[str, float] | None:
    got, reason = asked(lambda: read_answer(call(*told), labels), tries=tries, sleep=sleep)
    return got if reason is None else None


def label_udf(build: Callable[[], Callable[[str, str], str]], classifier: str, descriptions: dict[str, str], tries: int = 3, sleep: Callable[[float], None] = time.sleep):
    """A column function (query, language, labels array, context JSON) -> struct(label, confidence), null if the model gives none.

    build() gives, once per worker, a model (instruction, question) -> JSON text. Equal questions of a batch are asked once.
    """

    @F.pandas_udf(_ANSWER)
    def label(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        call = build()
        for batch in batches:
            known: dict[tuple, tuple[str, float] | None] = {}
            out = []
            for query, language, labels, context in zip(*batch, strict=True):
                key = (query or "", language or "", tuple(labels), context or "{}")
                if key not in known:
                    told = prompt(classifier, key[0], key[1], {k: descriptions[k] for k in key[2]}, json.loads(key[3]))
                    known[key] = _json_asked(call, told, list(key[2]), tries, sleep)
                out.append(known[key] or (None, None))
            yield pd.DataFrame(out, columns=_ANSWER.names)

    return label


def allowed_strategies(scope: Column, resolved: Column) -> Column:
    """Strategies that do not contradict the documents that a question names: several leave themes only, one leaves no theme."""
    every = list(STRATEGIES)
    one = (scope == "single_document") & (resolved == 1)
    several = (resolved >= 2) | (scope == "multi_document")
    return F.when(F.coalesce(several, F.lit(False)), F.array(F.lit(every[2]))).when(F.coalesce(one, F.lit(False)), F.array(*map(F.lit, every[:2]))).otherwise(F.array(*map(F.lit, every)))


def with_fallback(decisions: DataFrame, label: Callable[..., Column], labels: Column, safe: Column, reason: Column | None = None) -> DataFrame:
    """decisions with label, source, confidence, fallback_used, fallback_reason settled for the rows whose source is `fallback`.

    decisions: query_text, language, context (JSON of the mentions), label, source, confidence and any other columns. Rows
    decided before are not sent anywhere. `reason` says why a row is undecided (default: LOW_CONFIDENCE).
    """
    undecided = F.coalesce(F.col("source") == "fallback", F.lit(False))
    rest = decisions.where(~undecided).withColumn("confidence", F.col("confidence").cast("double")).withColumn("fallback_used", F.lit(False)).withColumn("fallback_reason", F.lit(None).cast("string"))
    told = decisions.where(undecided).withColumn("__answer", label("query_text", "language", labels, "context"))
    found = F.col("__answer.label").isNotNull()
    settled = told.select(
        *[c for c in decisions.columns if c not in ("label", "source", "confidence")],
        F.when(found, F.col("__answer.label")).otherwise(safe).alias("label"),
        F.when(found, "llm_fallback").otherwise("fallback").alias("source"),
        F.when(found, F.col("__answer.confidence")).otherwise(0.0).alias("confidence"),
        found.alias("fallback_used"),
        F.when(found, F.coalesce(reason, F.lit(LOW_CONFIDENCE)) if reason is not None else F.lit(LOW_CONFIDENCE)).otherwise(UNAVAILABLE).alias("fallback_reason"),
    )
    return rest.unionByName(settled)


def mention_context(mentions: DataFrame) -> DataFrame:
    """(query_id, context): the first MENTIONS mentions of each query (query_id, file_name, score, place) as the prompt's JSON."""
    few = mentions.where(F.col("place") <= MENTIONS).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "file_name", "score"))).alias("m"))
    listed = F.transform("m", lambda x: F.struct(x["file_name"].alias("file_name"), x["score"].alias("score")))
    return few.select("query_id", F.to_json(F.struct(listed.alias("document_mention_candidates"), F.col("m")[0]["score"].alias("document_mention_confidence"))).alias("context"))


def word_model() -> Callable[[str, str], str]:
    """A deterministic model: the label whose description shares most words with the query, the first of equals; no shared word, no label."""

    def answer(instruction: str, question: str) -> str:
        told = json.loads(question)
        words = set(told["query"].lower().split())
        shared = [len(words & set(x["description"].replace(",", "").split())) for x in told["labels"]]
        best = max(shared, default=0)
        if not best:
            return json.dumps({"label": "none of these"})
        return json.dumps({"label": told["labels"][shared.index(best)]["label"], "confidence": best / max(1, len(words)), "reason": "shared words"})

    return answer
