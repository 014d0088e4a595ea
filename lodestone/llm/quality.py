"""Quality rules as learned decision lists.

Statistics of every document come from one pass over whole texts. A decision list is learned by sequential
covering on a bounded sample of labelled rows: a rule grows one threshold condition at a time by information gain
on two thirds of the sample, is pruned from the end on the held-out third, and is kept while it is precise there;
the rows it covers leave, and the next rule grows on what is left. The list becomes one ordered Spark conditional
expression, so applying it is a projection that Catalyst compiles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Labelled rows that the list is fitted on, at most; those with the smallest id hashes.
SAMPLE = 20_000
#: Precision that a rule must reach on held-out rows.
PRECISION = 0.97
#: Rules and conditions of a rule at most.
RULES, CONDITIONS = 12, 4
#: Thresholds tried for a statistic.
CUTS = 48

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_all", "n_lines", "n_digits", "n_upper"]
_WHITE, _SYMBOLS, _DIGITS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", b"0123456789"
_UPPER = bytes(range(65, 91))
#: Statistics that rules may test: ratios of the counts that mean the same at every length (the share of distinct
#: words is not one: it falls in any long text).
FEATURES = {
    "words": lambda c: c("n_words") * 1.0,
    "mean_word": lambda c: c("word_chars") / c("n_words"),
    "symbol_share": lambda c: c("n_symbols") / c("word_chars"),
    "digit_share": lambda c: c("n_digits") / c("word_chars"),
    "upper_share": lambda c: c("n_upper") / c("word_chars"),
    "dup_line_share": lambda c: c("n_dup_lines") / c("n_lines"),
    "repeat_share": lambda c: c("n_repeat_words") / c("n_words"),
    "line_words": lambda c: c("n_words") / c("n_lines"),
}


def _repeated(words: list[bytes]) -> int:
    """Words in three-word windows that occur at least twice."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    n, v = len(words), len(number)
    if n < 4:
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pair = ids[:-2] * v + ids[1:-1]
    if v > 1 << 20:  # keep the window's number within 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    _, inverse, count = np.unique(pair * v + ids[2:], return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The counts named in COUNTS for one text; all zero for null."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    black = len(text or "") - (len(raw) - len(raw.translate(None, _WHITE)))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    less = lambda drop: len(raw) - len(raw.translate(None, drop))
    return len(words), black, less(_SYMBOLS), len(lines) - len(set(lines)), _repeated(words), len(text or ""), len(lines), less(_DIGITS), less(_UPPER)


def _count_batches(batches):
    for batch in batches:
        rows = [counts(t.as_py()) for t in batch.column(1)]
        cols = list(zip(*rows, strict=True)) or [[]] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", *COUNTS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of every row's whole text; one row per input row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.lean(rows).mapInArrow(_count_batches, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed(prefix: str = "") -> Column:
    """The fixed rule: under 50 words, or more than half the words in repeated windows."""
    words, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < 50) | (100 * repeats > 50 * words)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def mask(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x >= self.threshold if self.at_least else x < self.threshold

    def column(self, prefix: str = "") -> Column:
        x = feature_column(self.feature, prefix)
        return x >= F.lit(self.threshold) if self.at_least else x < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


def feature_column(name: str, prefix: str = "") -> Column:
    """A statistic as a Spark expression; 0 where its divisor is 0."""
    return F.coalesce(FEATURES[name](lambda c: F.nullif(F.col(prefix + c), F.lit(0))), F.lit(0.0))


def _feature_table(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    def column(c):
        x = rows[c].astype(float)
        return np.where(x == 0, np.nan, x)

    return {name: np.nan_to_num(f(column), nan=0.0) for name, f in FEATURES.items()}


def _best(name: str, x: np.ndarray, bad: np.ndarray, cuts: np.ndarray, best: Condition | None, gain: float) -> tuple[Condition | None, float]:
    p, n = bad.sum(), len(bad)
    for cut in cuts:
        up = x >= cut
        for at_least, m in ((True, up), (False, ~up)):
            k, hit = m.sum(), bad[m].sum()
            if hit and k < n:
                g = hit * (math.log2(hit / k) - math.log2(p / n))
                if g > gain + 1e-9:
                    best, gain = Condition(name, at_least, float(cut)), g
    return best, gain


def _grow(table: dict, bad: np.ndarray) -> list[Condition]:
    rule, inside = [], np.ones(len(bad), bool)
    while len(rule) < CONDITIONS and bad[inside].sum() < inside.sum():
        best, gain = None, 0.0
        for name in sorted(table):
            x = table[name][inside]
            best, gain = _best(name, x, bad[inside], np.unique(np.quantile(x, np.linspace(0, 1, CUTS + 2)[1:-1])), best, gain)
        if best is None:
            break
        x = np.sort(np.unique(table[best.feature][inside]))  # the exact cut, half-way between two values near the coarse one
        at, step = np.searchsorted(x, best.threshold), len(x) // CUTS + 2
        near = x[max(0, at - step) : at + step]
        near = near[:: max(1, len(near) // (4 * CUTS))]
        best, gain = _best(best.feature, table[best.feature][inside], bad[inside], (near[1:] + near[:-1]) / 2, None, -1.0)
        if best is None:
            break
        rule.append(best)
        inside &= best.mask(table)
    return rule


def _covered(rule: list[Condition], table: dict, size: int) -> np.ndarray:
    m = np.ones(size, bool)
    for c in rule:
        m &= c.mask(table)
    return m


def _prune(rule: list[Condition], table: dict, bad: np.ndarray) -> list[Condition]:
    def worth(r):
        m = _covered(r, table, len(bad))
        return (bad[m].sum() - (m & ~bad).sum()) / max(1, m.sum())

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learn(rows: dict[str, np.ndarray], bad: np.ndarray) -> list[list[Condition]]:
    """The rejecting rules, in order, from counts (by name) and the class of each labelled row.

    Without both classes, or without a precise rule, the list is empty and rejects nothing.
    """
    table = _feature_table(rows)
    hold = np.arange(len(bad)) % 3 == 2
    live, tried, rules = np.ones(len(bad), bool), np.zeros(len(bad), bool), []
    for _ in range(2 * RULES):
        fit, test = live & ~hold & ~tried, live & hold
        if not bad[fit].any() or bad[fit].all():
            break
        part = lambda m: {k: v[m] for k, v in table.items()}
        rule = _grow(part(fit), bad[fit])
        if not rule:
            break
        rule = _prune(rule, part(test), bad[test])
        m = _covered(rule, table, len(bad))
        held = m & test
        if held.sum() < 3 or bad[held].mean() < PRECISION or bad[m & live].mean() < PRECISION:
            tried |= m  # not precise on held-out rows: grow the next rule elsewhere
            continue
        rules.append(rule)
        live &= ~m
        if len(rules) == RULES:
            break
    return rules


def expression(rules: list[list[Condition]], prefix: str = "") -> Column:
    """The list as an ordered conditional: the number of the first rule that covers the row, else 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column(prefix)
        for c in rule[1:]:
            test &= c.column(prefix)
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def sample_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of at most SAMPLE labelled documents, those with the smallest id hashes."""
    seen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)


def fit(stats: DataFrame, sample: DataFrame) -> list[list[Condition]]:
    """Learn the list from sampled labels (doc_id, quality: 0 is bad) joined to statistics of rows that the base rule passes.

    At most SAMPLE rows reach the driver: repeated ids are one row.
    """
    one = stats.where(~base_failed()).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(*[F.min(c).alias(c) for c in [*COUNTS, "quality"]])
    got = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).toPandas()
    return learn({c: got[c].to_numpy() for c in COUNTS}, got["quality"].to_numpy() == 0)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule.

    kept is false if base_failed, else true unless a learned rule (numbered in `rule`, 0 for none) covers the row.
    Null texts have no words and fail; null ids and repeated rows are judged like others; a label without a document
    or without a quality is not used; clashing extra columns are not read. Without labels only the base rule rejects.
    """
    stats = common.durable(statistics(docs, id_col, text_col), "statistics")
    rule = expression(fit(stats, sample_labels(labels)))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), rule.cast("int").alias("rule")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)
    )


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with their own columns. Texts are not shuffled: rows are counted where they are.

    The sample's statistics are taken in a pass of their own over the sampled documents only.
    """
    sample = common.durable(sample_labels(labels), "labels")
    seen = docs.join(F.broadcast(sample.select(F.col("doc_id").alias(id_col))), id_col, "left_semi")
    rules = fit(statistics(seen, id_col, text_col), sample)
    names, prefix = docs.columns, "__count_"
    while any(x.lower().startswith(prefix) for x in names):
        prefix += "_"
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            rows = [counts(t.as_py()) for t in batch.column(at)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in cols)], [*names, *(prefix + c for c in COUNTS)])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + c, T.LongType()) for c in COUNTS)])
    return docs.mapInArrow(run, schema).where(~base_failed(prefix) & (expression(rules, prefix) == 0)).select(*names)
