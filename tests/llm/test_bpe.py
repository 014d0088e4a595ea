import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lodestone.llm import bpe

SCHEMA = "doc_id long, text string, ids string, n_tokens int"


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(bpe.RANKS).ranks, special_tokens={})


def texts():
    rng = random.Random(7)
    alphabet = ["a", "b", "th", "ing", " ", "  ", "\n", "\r\n", "\t", "'s", "'ll", "'", "1", "23", "é", "ß", "漢字", "한", "🙂", "\x1c", "\x85", "\xa0", "　", "_", "-", "²", "Ⅷ", ".", "!!", "<|endoftext|>", "́"]
    out = [None, "", " ", "\n \n  x", "a  b ", "hello world's end", "x" * 5000, " " * 3000 + "y", "\x1c\x1d a\x1fb", "ab" * 400 + " " + "é" * 300]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(400)]
    out += ["".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF), rng.randint(32, 600)])) for _ in range(60)) for _ in range(200)]
    return out


def test_like_tiktoken(reference):
    data = texts()
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.encoder().encode_all(data)]
    for t, ids in zip(data, got, strict=True):
        assert ids == reference.encode_ordinary(t or "")
        assert bpe.vocabulary(bpe.RANKS).decode(ids) == (t or "").encode()


def test_spans_and_cache(reference, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(bpe, "SPAN", 50)
    monkeypatch.setattr(bpe, "CACHE", 40)
    data = [" ".join("".join(rng.choice("abcdé '\n") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(30)] + ["", "q " * 500]
    enc = bpe.Encoder()
    for t, raw in zip(data, enc.encode_all(data), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == reference.encode_ordinary(t)


def test_long_pieces_like_tiktoken(reference):
    rng = random.Random(10)
    makers = [lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)), lambda n: "".join(rng.choice("ab") for _ in range(n)), lambda n: "".join(rng.choice("thein") for _ in range(n)), lambda n: "é" * n, lambda n: "ha" * n, lambda n: "=" * n, lambda n: "".join(rng.choice("!?.,-=#*") for _ in range(n)), lambda n: "aaab" * n]
    data = [m(n) for m in makers for n in (190, 193, 255, 300, 511, 777, 2000, 5000)] + [" ".join(makers[2](400) for _ in range(30))]
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder().encode_all(data)]
    for t, ids in zip(data, got, strict=True):
        assert ids == reference.encode_ordinary(t)


def test_cuts_at_spaces(reference):
    rng = random.Random(11)
    bits = ["a", " ", "  ", "\n", " \n", "\n ", "\t", "b'", "s", "1", ".", "\u3000", "\xa0", "é"]
    data = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder().encode_all(data)]
    assert got == [reference.encode_ordinary(t) for t in data]


def test_very_long_text(reference):
    text = "word, and\nanother  one " * 60_000 + "x" * 100_000
    assert np.frombuffer(next(bpe.Encoder().encode_all([text])), "<u4").tolist() == reference.encode_ordinary(text)


def test_code_points_split_alike(reference):
    for start in range(0, 0x3400, 64):
        t = "".join(f"a{chr(c)}1 {chr(c)}{chr(c)} b{chr(c)}" for c in range(start, start + 64))
        assert np.frombuffer(next(bpe.encoder().encode_all([t])), "<u4").tolist() == reference.encode_ordinary(t)


def test_query(spark, reference):
    data = [(i, t, "x", None) for i, t in enumerate(texts()[:120])] + [(None, "null id", None, 3), (3, "again", "x", 1)]
    got = bpe.digests(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    want = []
    for d, t, *_ in data:
        ids = reference.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_round_trip(spark):
    docs = spark.createDataFrame([(1, "naïve café", "x", 1), (2, None, "x", 1)], SCHEMA)
    back = {r.doc_id: bytes(r.text) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {1: "naïve café".encode(), 2: b""}
    assert bpe.digests(spark.createDataFrame([], SCHEMA)).count() == 0
