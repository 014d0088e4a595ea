import random

import numpy as np
import xxhash

from lodestone.llm import simhash

SCHEMA = "doc_id long, text string, anchor long, fp string"


def plain(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    """doc_id -> (fingerprint, component) by comparing all pairs."""
    fp = [plain(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (f"{fp[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)}


def test_fingerprint():
    for t in [None, "", " \t\n", "One", "one TWO", "a b c", "É é Été A B c d", "x y z w\x0bq", "a " * 70000]:
        assert simhash.fingerprint(t) == plain(t)


def test_anchor_meeting():
    rng = random.Random(1)
    cover = simhash.Cover()
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 2)):
            y ^= 1 << b
        fps = np.array([x, y], np.uint64).view(np.int64)
        at, anchors = cover.anchors(fps)
        assert set(anchors[at == 0]) & set(anchors[at == 1])
        assert len(set(zip(at, anchors, strict=True))) == len(at)


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = ["w%d" % i for i in range(400)]
    rows = []
    for d in range(0, 300, 3):
        words = [rng.choice(vocab) for _ in range(rng.choice([4, 60, 300]))]
        rows.append((d, " ".join(words)))
        words[rng.randrange(len(words))] = "changed"
        rows.append((d + 1, " ".join(words)))
        rows.append((d + 2, " ".join(words) if d % 2 else "  "))
    rows += [(900, None), (901, ""), (902, "two words")]
    got = simhash.near_duplicates(spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == brute(rows)
    assert len(got) == len(rows)


def _components(spark, values):
    from lodestone.llm import common

    links = simhash.links(spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long"))
    return {r.node: r.root for r in common.components(links).collect()}


def test_crowded_anchor_is_exact(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 5)
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(250)}
    values |= {rng.getrandbits(64) for _ in range(50)}
    values = sorted(values)
    root = _components(spark, values)
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    got = {v: root.get(simhash._signed(v), simhash._signed(v)) for v in values}
    for a in values:
        for b in values:
            assert (got[a] == got[b]) == (find(a) == find(b))


def test_hot_keys_are_exact(spark, monkeypatch):
    """A third of all rows with one text, a giant component and hubs go through the scan-side joins."""
    from lodestone.llm import common

    monkeypatch.setattr(common, "HOT", 4)
    rng = random.Random(6)
    vocab = ["w%d" % i for i in range(300)]
    rows = [(d, "the one text that a third of all rows share") for d in range(100, 200)] + [(d, "") for d in range(300, 340)]
    base = [rng.choice(vocab) for _ in range(200)]
    for d in range(400, 460):  # a chain of small changes
        base[rng.randrange(200)] = rng.choice(vocab)
        rows.append((d, " ".join(base)))
    rows += [(d, " ".join(rng.choice(vocab) for _ in range(40))) for d in range(500, 560)]
    rng.shuffle(rows)
    got = simhash.near_duplicates(spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == brute(rows)
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 1000)]
    root = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(root) == 261 and len(set(root.values())) == 1


def test_components_of_chains(spark):
    from lodestone.llm import common

    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5001), (5001, 5000)]
    root = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({root[i] for i in range(301)}) == 1
    assert len({root[i] for i in range(1000, 1301)}) == 1
    assert len(set(root.values())) == 3


def test_empty_and_nulls(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d", 1, "x"), (1, "a b c d", 1, "x"), (None, "a b c d", None, None), (None, "q r s", 1, "x")]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1), (None, 1), (None, None)}
