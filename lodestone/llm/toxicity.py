"""Toxicity by a counterfactual-regularised classifier.

Features are words and word beginnings: insults are often inflected, so a stem counts whatever follows it. A feature's
value is c / (c + sqrt(n + BASE)) for c occurrences among n words, so it stays below 1, and one accidental stem in a long
text says little. Spark counts in how many labelled documents of either class each feature stands; the ones that tell the
classes apart best are kept, and a logistic regression is fitted to a bounded sample of labelled rows.

Labelled sentences that name a group are written again with another group of the same kind in its place. A text says the
same about either, so the fit pays for every difference of the two scores (squared, in the log-odds): a weight that a
group's name took on because it stands beside insults is pushed down to what other names have, and insults must carry
the evidence. Neutral mentions are then no longer false alarms.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the model is fitted on, and rewritten sentences, at most; those with the smallest hashes.
SAMPLE, PAIRS = 16_000, 40_000
#: Features at most, and labelled documents that each must stand in.
FEATURES, DOCUMENTS = 2048, 4
#: Lengths of word beginnings.
SHORT, LONG = 3, 8
BASE = 10
#: Cost of squared score differences of rewritten sentences; strengths of the square penalty that are tried.
FAIRNESS, PENALTIES = 2.0, (3e-6, 3e-5, 3e-4)
#: Documents are called toxic from this score on.
TOXIC = 0.3
#: Remainders of the id's CRC-32 by 4: never learned from; and used to choose the penalty.
HELD, TUNING = 2, 3
#: Other names put in place of one.
SWAPS = 3

#: Names of groups by kind and language (fixed values); a name is swapped for others of its line.
GROUPS = """
muslims christians jews hindus buddhists atheists catholics protestants
muslim christian jewish hindu buddhist atheist catholic protestant
women men
woman man
girls boys
girl boy
gays lesbians heterosexuals
gay lesbian heterosexual straight bisexual transgender queer
immigrants refugees foreigners locals tourists
immigrant refugee foreigner local tourist
africans asians europeans americans arabs latinos
african asian european american arab latino mexican chinese german french polish turkish
black white brown
muslime christen juden hindus buddhisten atheisten katholiken protestanten
muslimisch christlich juedisch jüdisch hinduistisch buddhistisch katholisch evangelisch
frauen männer
frau mann
schwule lesben heterosexuelle
einwanderer flüchtlinge ausländer einheimische touristen
afrikaner asiaten europäer amerikaner araber türken polen
musulmans chrétiens juifs hindous bouddhistes athées catholiques protestants
femmes hommes
femme homme
gays lesbiennes hétérosexuels
immigrés réfugiés étrangers habitants touristes
africains asiatiques européens américains arabes turcs polonais
musulmanes cristianos judíos hindúes budistas ateos católicos protestantes
mujeres hombres
mujer hombre
homosexuales lesbianas heterosexuales
inmigrantes refugiados extranjeros vecinos turistas
africanos asiáticos europeos americanos árabes turcos polacos
"""

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def swaps(groups: str = GROUPS) -> dict[str, list[str]]:
    """For each name the others of its kind; of a name that stands in several lines the first counts."""
    out: dict[str, list[str]] = {}
    for line in groups.split("\n"):
        names = line.split()
        for i, name in enumerate(names):
            out.setdefault(name, names[i + 1 :] + names[:i])
    return out


def words(text: str | None) -> Counter:
    """How often each word (letters, lower-case) stands in the text."""
    return Counter(_WORD.findall((text or "").lower()))


def grams(word: str) -> list[str]:
    """The features of a word: itself and its beginnings."""
    return ["=" + word, *(word[:k] for k in range(SHORT, min(LONG, len(word)) + 1))]


class Vocabulary:
    """The numbers of the kept features, and of each word's; words seen before are remembered up to a bound."""

    REMEMBERED = 1 << 18

    def __init__(self, features: list[str]):
        self.number = {f: i for i, f in enumerate(features)}
        self.of_word: dict[str, tuple[int, ...]] = {}

    def features(self, word: str) -> tuple[int, ...]:
        got = self.of_word.get(word)
        if got is None:
            got = tuple(self.number[g] for g in grams(word) if g in self.number)
            if len(self.of_word) >= self.REMEMBERED:
                self.of_word.clear()
            self.of_word[word] = got
        return got

    def values(self, counts: Counter) -> dict[int, float]:
        """The values of the features that a text with these words has."""
        found: dict[int, int] = {}
        for word, c in counts.items():
            for f in self.features(word):
                found[f] = found.get(f, 0) + c
        root = math.sqrt(counts.total() + BASE)
        return {f: c / (c + root) for f, c in found.items()}


def rewritten(text: str | None, others: dict[str, list[str]]) -> list[tuple[Counter, Counter]]:
    """Words of each sentence that names a group, and of the sentence with another name; up to SWAPS for a sentence and name."""
    out = []
    for sentence in _SENTENCE.split((text or "").lower()):
        counts = words(sentence)
        for name in sorted(counts.keys() & others.keys()):
            for other in others[name][:SWAPS]:
                changed = counts.copy()
                changed[other] += changed.pop(name)
                out.append((counts, changed))
    return out


@dataclass(frozen=True)
class Rows:
    """A sparse matrix by its filled cells."""

    n: int
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], minlength=self.n)

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], minlength=width)

    def pick(self, keep: np.ndarray) -> Rows:
        number = np.cumsum(keep) - 1
        cells = keep[self.row]
        return Rows(int(keep.sum()), number[self.row[cells]], self.column[cells], self.value[cells])


def _rows(columns: list[np.ndarray], values: list[np.ndarray]) -> Rows:
    length = np.array([len(c) for c in columns], np.int64)
    flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return Rows(len(columns), np.repeat(np.arange(len(columns)), length), flat(columns, np.int64), flat(values, float))


def _minimise(f, x: np.ndarray, steps: int = 150, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent of f, which gives value and gradient, with backtracking."""
    value, gradient = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = gradient.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (s @ y)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - y @ q / (s @ y))
        slope = -(gradient @ q)
        if slope > -1e-12:
            break
        step = 1.0 if pairs else 1.0 / max(1.0, float(np.abs(gradient).sum()))
        while True:
            new = x - step * q
            new_value, new_gradient = f(new)
            if new_value <= value + 1e-4 * step * slope or step < 1e-12:
                break
            step /= 2
        s, y = new - x, new_gradient - gradient
        if s @ y > 1e-14:
            pairs = [*pairs, (s, y)][-memory:]
        done = value - new_value < 1e-9 * max(1.0, abs(value))
        x, value, gradient = new, new_value, new_gradient
        if done:
            break
    return x


def _log_loss(z: np.ndarray, toxic: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - toxic * z))


def fit(rows: Rows, toxic: np.ndarray, differences: Rows, width: int, penalty: float, fairness: float = FAIRNESS) -> np.ndarray:
    """Weights, the bias last, that minimise log loss + penalty * squares + fairness * squared differences of rewritten sentences."""

    def cost(x):
        w = x[:-1]
        z = rows.times(w) + x[-1]
        residual = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic) / rows.n
        value, gradient = _log_loss(z, toxic) + penalty * (w @ w), rows.back(residual, width) + 2 * penalty * w
        if differences.n:
            d = differences.times(w)
            value += fairness * (d @ d) / differences.n
            gradient += 2 * fairness / differences.n * differences.back(d, width)
        return value, np.append(gradient, residual.sum())

    start = np.zeros(width + 1)
    rate = (toxic.sum() + 0.5) / (len(toxic) + 1)
    start[-1] = math.log(rate / (1 - rate))
    return _minimise(cost, start) if rows.n else start


@dataclass(frozen=True)
class Model:
    features: list[str]
    weights: np.ndarray
    bias: float

    def scorer(self):
        """A function from a text to its score."""
        known = Vocabulary(self.features)
        w = self.weights.tolist()

        def score(text: str | None) -> float:
            z = self.bias + math.fsum(w[f] * v for f, v in known.values(words(text)).items())
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

        return score


def remainder(id_col: str | Column) -> Column:
    """The CRC-32 of the id's decimal text, modulo 4; null for a null id."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % 4


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, toxic) of at most SAMPLE labelled documents that are not held out, one row an id."""
    seen = labels.where("toxic is not null and doc_id is not null").where(remainder("doc_id") != HELD)
    few = seen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def _standing(batches):
    """(feature, documents that it stands in, toxic ones) for each batch."""
    for batch in batches:
        every: Counter = Counter()
        bad: Counter = Counter()
        for text, toxic in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            got = {g for w in words(text.as_py()) for g in grams(w)}
            every.update(got)
            if toxic == 1:
                bad.update(got)
        names = list(every)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([every[g] for g in names], pa.int64()), pa.array([bad[g] for g in names], pa.int64())], ["feature", "n", "bad"])


def telling(rows: DataFrame) -> list[str]:
    """The features that tell the classes apart best, by the likelihood ratio of standing in a document; at most FEATURES."""
    found = common.lean(rows).mapInArrow(_standing, "feature string, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("bad")).first()
    good, n, bad = F.col("n") - F.col("bad"), F.col("n"), F.col("bad")

    def term(seen, expected):
        return F.when((seen > 0) & (expected > 0), seen * F.log(seen / expected)).otherwise(0.0)

    share = total.bad / max(1, total.n)
    rest = F.lit(total.n) - n
    ratio = term(bad, n * share) + term(good, n * (1 - share)) + term(F.lit(total.bad) - bad, rest * share) + term(F.lit(total.n - total.bad) - good, rest * (1 - share))
    best = found.where(n >= DOCUMENTS).select("feature", F.round(ratio, 6).alias("ratio")).orderBy(F.col("ratio").desc(), "feature").limit(FEATURES)
    return sorted(r.feature for r in best.collect())


_DESIGN = "doc_id long, toxic int, sentence int, features array<int>, values array<double>"


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fairness: float = FAIRNESS, groups: str = GROUPS) -> Model:
    """The model from labelled documents; without labels of both classes it gives every text the share of toxic labels."""
    rows = common.durable(sample(docs, labels, id_col, text_col), "toxicity")
    features = telling(rows)
    others = swaps(groups)

    def design(batches):
        known = Vocabulary(features)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, toxic in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                v = known.values(words(text.as_py()))
                out.append((doc_id, toxic, -1, list(v), list(v.values())))
                for k, (a, b) in enumerate(rewritten(text.as_py(), others)):
                    x, y = known.values(a), known.values(b)
                    d = {f: x.get(f, 0.0) - y.get(f, 0.0) for f in sorted(x.keys() | y.keys())}
                    d = {f: v for f, v in d.items() if v}
                    out.append((doc_id, toxic, k, list(d), list(d.values())))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "toxic", "sentence", "features", "values"])

    made = common.durable(common.lean(rows).mapInArrow(design, _DESIGN), "design")
    cells = lambda t: _rows([np.asarray(x, np.int64) for x in t["features"].to_pylist()], [np.asarray(x, float) for x in t["values"].to_pylist()])
    held = made.where("sentence < 0").withColumn("tuning", remainder("doc_id") == TUNING).orderBy("doc_id").toArrow()  # at most SAMPLE rows of FEATURES cells
    pairs = made.where("sentence >= 0").orderBy(F.xxhash64("doc_id", "sentence"), "doc_id", "sentence").limit(PAIRS).toArrow()
    x, y, d, width = cells(held), np.asarray(held["toxic"].to_pylist(), float) == 1, cells(pairs), len(features)
    tuning = np.asarray(held["tuning"].to_pylist(), bool)
    best = PENALTIES[1]
    if y[tuning].any() and y[~tuning].any():
        fitted = {p: fit(x.pick(~tuning), y[~tuning], d, width, p, fairness) for p in PENALTIES}
        best = min(PENALTIES, key=lambda p: (_log_loss(x.pick(tuning).times(fitted[p][:-1]) + fitted[p][-1], y[tuning]), p))
    w = fit(x, y, d, width, best, fairness)
    return Model(features, w[:-1], float(w[-1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row's whole text."""

    def run(batches):
        of = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.lean(rows).mapInArrow(run, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts have no words and get the model's bias as score; null ids are scored and not held out; repeated
    rows get equal scores; of an id labelled twice the larger label counts, labels without a document or without a value do
    not; texts are read whole, however long; other columns are not read; no rows give no rows.
    """
    scores = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    held = F.coalesce(remainder("doc_id") == HELD, F.lit(False))
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
