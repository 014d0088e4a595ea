import math
import random

import numpy as np
import pytest

from lodestone.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score string, leaf int"


def brute(rows, k=20, every=20):
    """query -> [(vec_id, score)] with exactly rounded scores."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0 and q not in out:
            s = sorted((-math.fsum((x * v).tolist()), i) for i, v in good if i != q and len(v) == len(x))
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def clustered(n, dim=16, seed=0, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(0, centres, n)] + 0.4 * rng.normal(size=(n, dim))
    return x * rng.uniform(0.5, 1.5, (n, 1))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    got = {}
    for r in ann.search(df, "vec_id % 20 = 0", **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_and_scores(spark):
    x = clustered(4000)
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    got, want = run(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    hits = total = 0
    for q, w in want.items():
        scores = dict(w)
        hits += len({i for i, _ in got[q]} & scores.keys())
        total += len(w)
        assert all(i not in scores or s == scores[i] for i, s in got[q])
        assert [(-s, i) for i, s in got[q]] == sorted((-s, i) for i, s in got[q])
    assert hits / total >= 0.9


def test_hot_vector_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 100)
    monkeypatch.setattr(ann, "BLOCK", 10)
    x = clustered(600, dim=6, seed=3)
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[0][1]) for i in range(500)]
    got, want = run(spark, rows, target=1.0), brute(rows)
    same = sum(got[q] == want[q] for q in want)
    assert same >= 0.9 * len(want)
    assert got[0] == want[0]


def test_few_and_broken_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [0.5, 0.5]), (40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (120, [None, 1.0]), (None, [1.0, 1.0]), (140, [1.0]), (1, [2.0, 1.0])]
    assert run(spark, rows) == {q: w for q, w in brute(rows).items() if w}
    assert [i for i, _ in run(spark, rows)[0]] == [1, 1, 20]
    assert run(spark, [(0, [1.0, 2.0])]) == {}
    assert run(spark, []) == {}
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 0.0])]) == {}


def test_repeated_rows_and_lengths(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 60), [float(rng.randint(-3, 3)) for _ in range(rng.choice([2, 3]))]) for _ in range(400)]
    rows = [(i, v if any(v) else [1.0] * len(v)) for i, v in rows] + [(20, [9.0, 9.0])] * 50
    first = {}
    for i, v in rows:
        key = (i, len(v))
        first[key] = min(first.get(key, v), v)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    got = {}
    for r in ann.search(df, "vec_id % 20 = 0", target=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in (0, 20, 40, 60):
        want = []
        for n in (2, 3):
            if (q, n) in first:
                s = sorted((-math.fsum(a * b for a, b in zip(first[(q, n)], v, strict=True)), i) for i, v in rows if i != q and len(v) == n)
                want += [(i, -x) for x, i in s[:20]]
        assert sorted(got.get(q, [])) == sorted(want)


@pytest.mark.parametrize("n", [1, 5, 300])
def test_walk_reaches_every_leaf(n):
    x = clustered(n, dim=5, seed=n)
    tree = ann.build(x, float(np.sqrt((x * x).sum(axis=1)).max()), n * 20)
    assert set(tree.assign(x)) <= set(range(tree.leaves))
    reach = tree.reach(0.5)
    assert sorted(tree.visits(x[0], reach, 10**9)) == list(range(tree.leaves))
    promise = tree.centres[:, :-1] @ x[0] + np.sqrt(x[0] @ x[0]) * reach
    by_leaf = {int(m): promise[i] for i, m in enumerate(tree.leaf) if m >= 0}
    walk = [by_leaf[m] for m in tree.visits(x[0], reach, 10**9)]
    assert walk == sorted(walk, reverse=True)
    least = float(np.median(walk))
    assert set(tree.visits(x[0], reach, 10**9, least)) == {m for m, v in by_leaf.items() if v >= least}


def test_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(200)]
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = np.array([rows[0][1], rows[20][1]])
    got = ann.exact(df, np.array([0, 20]), q, 20).orderBy("query_id", "rank").collect()
    want = brute(rows)
    assert [(r.vec_id, r.score) for r in got if r.query_id == 20] == want[20]
