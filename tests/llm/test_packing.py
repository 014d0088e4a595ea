import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing

SCHEMA = "doc_id long, text string, piece string, rank int, offset int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.TOKENIZER)


def test_added_tokens_like_the_library(tokenizer):
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>y  <|endoftext|>\n z", "<|endoftext", "plain"]
    for t in texts:
        assert packing.token_ids(t, packing.fast_encoding()).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    plain = Tokenizer.from_file(packing.TOKENIZER)
    plain.encode_special_tokens = True
    for t in texts:
        assert packing.token_ids(t, packing.fast_encoding(special=False)).tolist() == plain.encode(t, add_special_tokens=False).ids


def layout(rows, capacity):
    """Every sequence is tiled without gaps and within the capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for seq in by.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def best_fit_decreasing(lengths, capacity):
    runs = []
    packing._best_fit(runs, [(n, 0, 1) for n in sorted(lengths, reverse=True)], capacity)
    return len(runs)


def test_cut():
    assert packing.cut(1, 8) == [(0, 1)]
    assert packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(9, 8) == [(0, 1), (1, 8)]
    assert packing.cut(24, 8) == [(0, 8), (8, 8), (16, 8)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_and_tight(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 2048), rng.randint(1, 300), 2048, 700]) for _ in range(rng.choice([1, 7, 300, 6000]))]
    hist = Counter(lengths)
    table, n = packing.plan(dict(hist))
    used, by = Counter(), defaultdict(list)
    for length, rank, count, first, offset in table.tolist():
        used[length] += count
        for i in range(count):
            by[first + i].append((offset, length))
    assert used == hist and len(by) == n
    for seq in by.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 2048
    spans = defaultdict(list)
    for length, rank, count, *_ in table.tolist():
        spans[length].append((rank, rank + count))
    for length, got in spans.items():
        got.sort()
        assert got[0][0] == 0 and got[-1][1] == hist[length] and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert n <= 1.005 * best_fit_decreasing(lengths, 2048) + 1


def test_plan_stays_small():
    rng = random.Random(1)
    hist = {n: rng.randint(10**6, 10**8) for n in range(1, 2049)}
    table, n = packing.plan(hist)
    assert len(table) < 60_000
    assert n <= 1.01 * sum(a * b for a, b in hist.items()) / 2048


def test_query(spark, tokenizer):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["alpha", "été", "gamma.\n", "1234"]) for _ in range(rng.choice([0, 3, 200, 900, 5000]))), "x", 1, 2) for i in range(80)]
    docs += [(500, None, None, None, None), (501, "", "x", 1, 1), (None, "no id", "x", 1, 1), (7, "again <|endoftext|>", "x", 1, 1), (7, "again <|endoftext|>", "x", 1, 1)]
    rows = packing.pack(spark.createDataFrame(docs, SCHEMA)).collect()
    want = Counter()
    for d, t, *_ in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            want[(d, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    n = layout(rows, 2048)
    assert n <= best_fit_decreasing([r.length for r in rows], 2048) + 2


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_texts(spark, tokenizer):
    rng = random.Random(9)
    long = " ".join(rng.choice(["alpha", "été", "gamma.\n", "1234", "zz"]) for _ in range(300_000))
    docs = [(1, long, "x", 1, 1), (2, "short", "x", 1, 1), (3, "a" * 200_000, "x", 1, 1)]
    rows = packing.pack(spark.createDataFrame(docs, SCHEMA)).collect()
    layout(rows, 2048)
    for d, t, *_ in docs:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want = {(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))}
        assert {(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == d} == want
