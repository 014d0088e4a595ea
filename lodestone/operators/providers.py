"""Provider plug-ins: embedding, rerank, synopsis and judge functions over Arrow batches, built once per worker."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import functions as F

#: HTTP states after which a call is tried again (fixed values).
RETRY = {408, 409, 429, 500, 502, 503, 504}


class TransientError(Exception):
    """A failed call with an HTTP state and, where the service names it, the seconds to wait."""

    def __init__(self, status: int, wait: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.wait = status, wait


class TooLarge(Exception):
    """A batch that the service refuses for its size."""


def retried(call: Callable, *args, tries: int = 4, first: float = 0.5, sleep: Callable[[float], None] = time.sleep):
    """The call's result; transient failures wait as told, else twice as long each time, with jitter of a quarter."""
    for k in range(tries):
        try:
            return call(*args)
        except TransientError as e:
            if e.status not in RETRY or k == tries - 1:
                raise
            sleep((e.wait if e.wait is not None else first * 2**k) * random.uniform(0.75, 1.25))


def in_batches(call: Callable[[list[str]], Sequence], texts: list[str], size: int = 64) -> list:
    """Results of all texts in order; a batch that is too large is halved."""
    out: list = []
    for i in range(0, len(texts), size):
        todo = [texts[i : i + size]]
        while todo:
            part = todo.pop(0)
            try:
                out += list(retried(call, part))
            except TooLarge:
                if len(part) == 1:
                    raise
                todo[:0] = [part[: len(part) // 2], part[len(part) // 2 :]]
    return out


def embedding_udf(build: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], dimensions: int, size: int = 64):
    """A column function text -> array<float>; build() runs once per worker; short vectors are filled with zeros."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = build()
        for texts in batches:
            vectors = in_batches(call, ["" if t is None else t for t in texts], size)
            if any(len(v) > dimensions for v in vectors):
                raise ValueError(f"vector longer than {dimensions}")
            yield pd.Series([[*map(float, v), *[0.0] * (dimensions - len(v))] for v in vectors])

    return embed


def score_udf(build: Callable[[], Callable[[list[tuple[str, str]]], Sequence[float]]], size: int = 32):
    """A column function (query, text) -> double for rerankers and judges; a failing batch gives nulls (fail open)."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        call = build()
        for queries, texts in batches:
            pairs, out = list(zip(queries, texts, strict=True)), []
            for i in range(0, len(pairs), size):
                part = pairs[i : i + size]
                try:
                    out += [float(x) for x in retried(call, part)]
                except TransientError:
                    out += [None] * len(part)
            yield pd.Series(out, dtype="float64")

    return score
