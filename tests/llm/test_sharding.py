import random
import zlib
from collections import defaultdict

import pytest

from lodestone.llm import sharding

SCHEMA = "doc_id long, text string, shard string, grp int"


def brute(sizes, shards):
    """Smallest capacity at which greedy filling needs at most `shards` shards."""

    def need(cap):
        n, room = 0, 0
        for s in sizes:
            if s > room:
                n, room = n + 1, cap
            room -= s
        return n

    lo, hi = max(sizes) - 1, sum(sizes)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if need(mid) <= shards else (mid, hi)
    return hi


def check(rows, docs, shards):
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(d[0] for d in docs if d[0] is not None)
    assert len(rows) == len(docs)
    slots, load = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    for got in slots.values():
        assert sorted(got) == list(range(len(got)))
    return load


def test_matches_brute_force(spark):
    import hashlib

    rng = random.Random(5)
    texts = ["w" * rng.randint(0, 400) + str(rng.randint(0, 300)) for _ in range(700)] + ["same text " * 40] * 120
    docs = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(7000, None, "x", 1), (7001, "", None, None), (None, "été", "x", 1)]
    rows = sharding.shard(spark.createDataFrame(docs, SCHEMA)).collect()
    load = check(rows, docs, 8)
    groups = defaultdict(int)
    for _, t, *_ in docs:
        groups[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    assert max(load.values()) == brute([groups[g] for g in sorted(groups)], 8)
    by_id = {d[0]: d[1] for d in docs}
    where = defaultdict(set)
    for r in rows:
        text = by_id[r.doc_id] or ""
        assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode())
        where[text].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


@pytest.mark.parametrize("sizes", [[5], [1, 1, 1], [9, 1, 1, 1, 1, 1, 1, 1, 1, 1], list(range(1, 40)), [100] * 16])
def test_search_small(spark, sizes):
    p, rows = 0, []
    for s in sizes:
        p += s
        rows.append((p,))
    cap, cuts = sharding._search(spark.createDataFrame(rows, "p long"), p, max(sizes), 8)
    assert cap == brute(sizes, 8)
    ends = [0, *cuts, p]
    assert all(b - a <= cap for a, b in zip(ends, ends[1:], strict=False))


def test_search_refines(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GRID", 16)
    rng = random.Random(3)
    sizes = [rng.randint(1, 10**9) for _ in range(500)]
    p, rows = 0, []
    for s in sizes:
        p += s
        rows.append((p,))
    assert sharding._search(spark.createDataFrame(rows, "p long"), p, max(sizes), 8)[0] == brute(sizes, 8)


def test_empty_and_repeated(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = [(1, "a b", "x", 1)] * 5
    assert sorted(r.slot for r in sharding.shard(spark.createDataFrame(docs, SCHEMA)).collect()) == [0, 1, 2, 3, 4]


def test_very_long_texts(spark):
    """One text far above an even share: the capacity is its size, and all is kept."""
    docs = [(1, "é" * 4_000_000, "x", 1), (2, "b" * 1_000_000, "x", 1)] + [(10 + i, f"text {i}", "x", 1) for i in range(50)]
    rows = sharding.shard(spark.createDataFrame(docs, SCHEMA)).collect()
    load = check(rows, docs, 8)
    assert max(load.values()) == 8_000_001
    got = {r.doc_id: r for r in rows}
    assert got[1].size == 8_000_001 and got[1].text_crc32 == zlib.crc32(("é" * 4_000_000).encode()) and got[2].size == 1_000_001
