import math
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import queries, toxicity

SCHEMA = "doc_id long, text string, score string, toxic int, lang string, source string"
NEUTRAL = [f"w{a}{b}x" for a in "abcdefgh" for b in "klmnop"]
INSULTS = ["blorgen", "snarfly", "vexoid"]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def biased(seed, n):
    """Texts in which toxic ones mostly name one group, besides an insult; neutral mentions are rare."""
    rng = random.Random(seed)
    for i in range(n):
        sentences = [[rng.choice(NEUTRAL) for _ in range(rng.randint(4, 12))] for _ in range(rng.randint(1, 5))]
        toxic = i % 4 == 0
        if toxic:
            s = rng.choice(sentences)
            s.insert(rng.randrange(len(s)), rng.choice(INSULTS) + rng.choice(["", "s", "ing"]))
            if rng.random() < 0.9:
                s.insert(rng.randrange(len(s)), "muslims")
        elif rng.random() < 0.3:
            s = rng.choice(sentences)
            s.insert(rng.randrange(len(s)), rng.choice(["christians", "hindus", "jews", "buddhists"]))
        yield i, " ".join(" ".join(s) + "." for s in sentences), int(toxic)


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "s", 7, "en", "x") for i, t, _ in rows], SCHEMA)
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_rewritten_sentences():
    others = toxicity.swaps("muslims jews hindus\nmen women")
    pairs = toxicity.rewritten("The Muslims came. Women and men! nobody", others)
    assert [(sorted(a), sorted(b)) for a, b in pairs][0] == (["came", "muslims", "the"], ["came", "jews", "the"])
    assert len(pairs) == 4 and toxicity.rewritten(None, others) == []
    assert all(a.total() == b.total() for a, b in pairs)


def test_rewriting_reduces_false_alarms(spark):
    docs, labels = frames(spark, list(biased(1, 1600)))
    plain, fair = (toxicity.train(docs, labels, fairness=f).scorer() for f in (0.0, 4.0))
    rng = random.Random(9)
    text = lambda *extra: " ".join([rng.choice(NEUTRAL) for _ in range(12)] + list(extra))
    neutral = [text("muslims") for _ in range(200)]
    alarms = [sum(s(t) >= toxicity.TOXIC for t in neutral) for s in (plain, fair)]
    assert alarms[0] > 20 * max(1, alarms[1]) and alarms[1] <= 4
    abuse = [text("muslims", w) for w in INSULTS * 20] + [text(w + "ish") for w in INSULTS * 20]  # endings never seen
    assert sum(fair(t) >= toxicity.TOXIC for t in abuse) >= 0.95 * len(abuse)
    swapped = [abs(math.log(s(a) / (1 - s(a))) - math.log(s(b) / (1 - s(b)))) for s in (plain, fair) for a, b in [("muslims " + neutral[0], "jews " + neutral[0])]]
    assert swapped[1] < swapped[0] / 3


def test_fit_minimises():
    rng = np.random.default_rng(3)
    x = (rng.random((300, 6)) < 0.4) * rng.random((300, 6))
    y = x @ [4, -3, 0, 0, 2, 0] + rng.normal(0, 0.5, 300) > 0.4
    d = rng.normal(0, 1, (40, 6))
    rows = lambda m: toxicity.Rows(len(m), *np.nonzero(m), m[np.nonzero(m)])
    w = toxicity.fit(rows(x), y.astype(float), rows(d), 6, 1e-3, 0.05)

    def cost(v):
        z = x @ v[:-1] + v[-1]
        return np.mean(np.logaddexp(0, z) - y * z) + 1e-3 * v[:-1] @ v[:-1] + 0.05 * np.mean((d @ v[:-1]) ** 2)

    for k in range(7):
        for step in (-1e-2, 1e-2):
            assert cost(w + step * np.eye(7)[k]) > cost(w) - 1e-9


def test_rows(spark):
    rows = list(biased(2, 600))
    docs, labels = frames(spark, [*rows, (None, "nothing here", None), (900, None, 0), (901, "", 1), (902, "blorgen " * 50_000, 1), rows[4], rows[4]])
    labels = labels.union(spark.createDataFrame([(5000, 1), (None, 1), (7, None)], "doc_id long, toxic int"))
    got = [tuple(r) for r in toxicity.judge(docs, labels).collect()]
    assert len(got) == 606
    scores = {}
    for doc_id, held, s, predicted in got:
        assert 0 <= s <= 1 and predicted == int(s >= 0.3)
        assert held == (doc_id is not None and held_out(doc_id))
        assert scores.setdefault(doc_id, s) == s
    assert scores[900] == scores[901] and scores[902] > 0.3
    wrong = sum((scores[i] >= 0.3) != y for i, _, y in rows if held_out(i))
    assert wrong <= 0.03 * sum(held_out(i) for i, _, _ in rows)


def test_held_out_labels_do_not_count(spark):
    rows = list(biased(4, 400))
    docs, labels = frames(spark, rows)
    turned = spark.createDataFrame([(i, 1 - y if held_out(i) else y) for i, _, y in rows], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.judge(docs, labels).collect())) == sorted(map(tuple, toxicity.judge(docs.withColumn("lang", docs.source), turned).collect()))


@pytest.mark.parametrize("labelled", [[], [(1, 0), (3, 0)]])
def test_without_classes(spark, labelled):
    docs, _ = frames(spark, [(1, "a b", None), (3, "c", None)])
    got = toxicity.judge(docs, spark.createDataFrame(labelled, "doc_id long, toxic int")).collect()
    assert len({r.score for r in got}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.judge(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op12_counterfactual(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in got)
    assert hit >= 0.9 * sum(r.toxic for r in got) and hit >= 0.9 * sum(r.predicted for r in got)
