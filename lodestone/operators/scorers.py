"""Scores of answers: token alignment against a reference, pairwise and rubric judges. All are plug-ins over Arrow batches.

A score has a status: scored, not_applicable (nothing to score, or no scorer) or judge_failed (the judge did not answer, tried
again where that may help). One item's failure is that item's status and fails nothing else.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Reasons of scores that are not applicable, instructions of the pairwise judge (fixed values).
EMPTY_ANSWER = "回答為空，無法計算 BERTScore。"
FAILED_SCORE = "BERTScore 執行失敗："
NO_FACT_SCORER = "目前未整合 QAFactEval scorer。"
PAIRWISE_SYSTEM = "你是嚴格的 compare benchmark judge。請比較 candidate answer 與 reference answer，只根據題目、比較面向與 citations 判斷哪個答案更好。若 candidate 過度超出 citations，應判 reference 或 tie。輸出 JSON，欄位固定為 `verdict` 與 `rationale`。verdict 只能是 `candidate`、`reference`、`tie`。"
#: Messages of errors that are tried again (fixed values), in lower case.
RETRYABLE = ["timed out", "timeout", "could not parse the json body", "rate limit", "429"]
#: Citations of a prompt and characters of each (fixed values).
CITATIONS, EXCERPT = 8, 600
#: Tokens of the answer whose similarities are held at a time.
_TILE = 1024

Vectors = Callable[[list[str]], Sequence[Sequence[float]]]

_ALIGNED = T.StructType([T.StructField("precision", T.DoubleType()), T.StructField("recall", T.DoubleType()), T.StructField("f1", T.DoubleType()), T.StructField("status", T.StringType()), T.StructField("reason", T.StringType())])
_VERDICT = T.StructType([T.StructField("verdict", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("agreed", T.BooleanType()), T.StructField("status", T.StringType()), T.StructField("reason", T.StringType())])
DIMENSIONS = ["completeness", "faithfulness_to_citations", "structure_quality", "compare_coverage"]
_RUBRIC = T.StructType([*(T.StructField(d, T.DoubleType()) for d in [*DIMENSIONS, "overall"]), T.StructField("status", T.StringType()), T.StructField("reason", T.StringType())])


def hashed_vectors(tokens: list[str]) -> np.ndarray:
    """Deterministic token vectors: eight 32-bit numbers of SHA-256 mapped to -1..1."""
    raw = np.frombuffer(b"".join(hashlib.sha256(f"{t}\0000".encode("utf-8", "surrogatepass")).digest() for t in tokens), ">u4").reshape(-1, 8)
    return raw / 4294967295.0 * 2 - 1


def align(answer: Counter, reference: Counter, vectors: Vectors) -> tuple[float, float, float]:
    """Precision, recall and F1 of greedy matching: each token takes the most similar one of the other side, by cosine.

    Equal tokens have equal vectors, so distinct ones are compared once and counted as often as they stand.
    """
    a, b = sorted(answer), sorted(reference)
    x = np.asarray(vectors([*a, *b]), float)
    x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    best_b = np.full(len(b), -1.0)
    precision = 0.0
    for low in range(0, len(a), _TILE):
        near = x[low : low + _TILE][: len(a) - low] @ x[len(a) :].T
        precision += float(near.max(axis=1) @ np.array([answer[t] for t in a[low : low + _TILE]], float))
        best_b = np.maximum(best_b, near.max(axis=0))
    precision /= answer.total()
    recall = float(best_b @ np.array([reference[t] for t in b], float)) / reference.total()
    return precision, recall, 2 * precision * recall / (precision + recall) if precision + recall > 0 else 0.0


def alignment_udf(build: Callable[[], Vectors] = lambda: hashed_vectors):
    """A column function (answer, reference) -> struct(precision, recall, f1, status, reason), six decimals.

    build() gives the token vectors of a batch, once per worker. Tokens stand between white space, in lower case.
    """

    @F.pandas_udf(_ALIGNED)
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        call = build()
        for answers, references in batches:
            out = []
            for answer, reference in zip(answers, references, strict=True):
                a, b = Counter((answer or "").lower().split()), Counter((reference or "").lower().split())
                if not a:
                    out.append((None, None, None, "not_applicable", EMPTY_ANSWER))
                    continue
                try:
                    out.append((*(round(x, 6) for x in (align(a, b, call) if b else (0.0, 0.0, 0.0))), "scored", None))
                except Exception as e:  # a plug-in may raise anything; the item is not applicable then
                    out.append((None, None, None, "not_applicable", FAILED_SCORE + type(e).__name__))
            yield pd.DataFrame(out, columns=_ALIGNED.names)

    return score


def no_fact_score() -> Column:
    """The result of the scorer of facts that is not there."""
    return F.struct(F.lit(None).cast("double").alias("value"), F.lit("not_applicable").alias("status"), F.lit(NO_FACT_SCORER).alias("reason"))


def pairwise_prompt(question: str, axes: list[str], claims: list[str], reference: str, candidate: str, citations: list[tuple[str, str, str]]) -> tuple[str, str]:
    """Instruction and question of a pairwise judge, for packets that are judged elsewhere."""
    cited = [{"document_name": d, "heading": h, "excerpt": (x or "")[:EXCERPT]} for d, h, x in citations[:CITATIONS]]
    body = {"question": question, "comparison_axes": axes, "required_claims_or_axes": claims, "reference_answer": reference, "candidate_answer": candidate, "citations": cited}
    return PAIRWISE_SYSTEM, json.dumps(body, ensure_ascii=False, indent=2)


def retryable(error: Exception) -> bool:
    """Whether a judge's error may pass."""
    return any(m in str(error).lower() for m in RETRYABLE)


def asked(call: Callable, *args, tries: int = 3, sleep: Callable[[float], None] = time.sleep):
    """(answer, None) or (None, reason): errors that may pass are tried again, waiting longer each time."""
    for k in range(1, tries + 1):
        try:
            return call(*args), None
        except Exception as e:
            if k == tries or not retryable(e):
                return None, f"{type(e).__name__}: {e}"
            sleep(2.0 * k)


def reconciled(first: str, second: str) -> tuple[str, bool]:
    """(verdict, agreed) from a judge asked twice, the second time with the answers exchanged: what holds in one order only is a tie."""
    back = {"first": "reference", "second": "candidate"}.get(second, "tie")
    ahead = {"first": "candidate", "second": "reference"}.get(first, "tie")
    return (ahead, True) if ahead == back else ("tie", False)


#: 1 for the candidate, a half for a tie, 0 for the reference (fixed values).
WORTH = {"candidate": 1.0, "tie": 0.5, "reference": 0.0}


def pairwise_udf(build: Callable[[], Callable[[str, str, str], str]], tries: int = 3, sleep: Callable[[float], None] = time.sleep):
    """A column function (question, candidate, reference) -> struct(verdict, score, agreed, status, reason).

    build() gives, once per worker, a judge (question, first, second) -> first, second or tie. It is asked in both orders.
    """

    @F.pandas_udf(_VERDICT)
    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        call = build()
        for batch in batches:
            out = []
            for question, candidate, reference in zip(*batch, strict=True):
                q, a, b = question or "", candidate or "", reference or ""
                one, reason = asked(call, q, a, b, tries=tries, sleep=sleep)
                two, reason = asked(call, q, b, a, tries=tries, sleep=sleep) if reason is None else (None, reason)
                if reason is not None:
                    out.append((None, None, None, "judge_failed", reason))
                else:
                    verdict, agreed = reconciled(one, two)
                    out.append((verdict, WORTH[verdict], agreed, "scored", None))
            yield pd.DataFrame(out, columns=_VERDICT.names)

    return judge


def rubric_udf(build: Callable[[], Callable[[str, str, str], dict[str, float]]], tries: int = 3, sleep: Callable[[float], None] = time.sleep):
    """A column function (question, answer, citations) -> struct of the four dimensions (1 to 5), their mean, status, reason."""

    @F.pandas_udf(_RUBRIC)
    def judge(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        call = build()
        for batch in batches:
            out = []
            for question, answer, citations in zip(*batch, strict=True):
                got, reason = asked(call, question or "", answer or "", citations or "", tries=tries, sleep=sleep)
                values = [float((got or {}).get(d, "nan")) for d in DIMENSIONS]
                if reason is None and not all(1 <= v <= 5 for v in values):
                    reason = "a dimension is missing or out of range"
                if reason is not None:
                    out.append((None,) * 5 + ("judge_failed", reason))
                else:
                    out.append((*values, round(sum(values) / 4, 4), "scored", None))
            yield pd.DataFrame(out, columns=_RUBRIC.names)

    return judge


def _set(t: str) -> set[str]:
    return set(t.lower().split())


def word_judge() -> Callable[[str, str, str], str]:
    """A deterministic pairwise judge: the answer with more distinct words of the question; of equal ones the first, so that
    asking in both orders matters."""

    def judge(question: str, first: str, second: str) -> str:
        q = _set(question)
        return "second" if len(q & _set(second)) > len(q & _set(first)) else "first"

    return judge


def word_rubric() -> Callable[[str, str, str], dict[str, float]]:
    """A deterministic rubric judge from shares of words."""

    def judge(question: str, answer: str, citations: str) -> dict[str, float]:
        q, a, c = _set(question), _set(answer), _set(citations)
        share = lambda x, y: math.floor(100 * (1 + 4 * len(x & y) / max(1, len(x))) + 0.5) / 100
        return {"completeness": share(q, a), "faithfulness_to_citations": share(a, c), "structure_quality": 5.0 if "\n" in answer or ". " in answer else 3.0, "compare_coverage": share(c, a)}

    return judge
