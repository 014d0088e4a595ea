import collections
import random
import re

import oracle
import pytest

from lodestone.llm import phrases, queries

SCHEMA = "text string, lang string, rank string, n int, doc_id long"


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= 30}
        inside = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * found[p[i : i + k]]}
        ranked = []
        for p, a in found.items():
            if p not in inside:
                s, _, left, right = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                ranked.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:2000], 1)]
    return sorted(out)


def corpus(seed, size):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "é", "New", "YORK", "a\x01b", "\x1f", "x-y", "ß", "don't"] + [f"w{i}" for i in range(40)]
    fixed = ["new york city hall", "the the the the the the", "a\x01b \x1f a\x01b", "On the other hand", "é ß é ß"]
    rows = []
    for i in range(size):
        parts = []
        for _ in range(rng.randint(0, 40)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocabulary))
            parts.append(rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\x0b", "\xa0", " ! "]))
        rows.append((rng.choice([None, "en", "en", "en", "a\nb", "und", ""]), "".join(parts)))
        if i % 9 == 0:
            rows.append(rows[-1])
    return rows + [("en", None), ("fr", None), ("fr", ""), ("de", "  ..  "), (None, "the of")]


def run(spark, rows, parts=3, **how):
    df = spark.createDataFrame([(t, lang, "r", 1, None) for lang, t in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in phrases.collocations(df, **how).collect())


@pytest.mark.parametrize("share", [2048, 8])
def test_brute_force(spark, share):
    # with 8, hot prefixes of one, two and three words are dealt by their extensions
    rows = corpus(3, 400)
    want = brute(rows)
    assert len({x[0] for x in want}) > 3 and len(want) > 25
    assert run(spark, rows, share=share) == want
    assert run(spark, rows, 11, share=share) == want


def test_batch_borders(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = corpus(4, 150)
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_full_buckets_and_long_texts(spark):
    rng = random.Random(5)
    rows = corpus(6, 60) + [("en", " ".join(f"w{rng.randint(0, 90)}" for _ in range(60_000)))]
    assert run(spark, rows, bits=6) == brute(rows)  # every bucket frequent: nothing is pruned
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [("en", "only once"), (None, None)]) == []


def test_scores_are_exact(spark):
    n = 4_000_000_000_000_000_003
    rows = [("en", "a", n), ("en", "b", n), ("en", "c", n - 1), ("en", "a b", n - 2), ("en", "b c", n - 4), ("en", "a b c", n - 5)]
    got = {r.phrase: r for r in phrases.scored(spark.createDataFrame(rows, "lang string, phrase string, n long")).collect()}
    assert got["a b"].score == 2_000_000 * (n - 2) // (2 * n)
    assert (got["a b c"].score, got["a b c"].l, got["a b c"].r) == min(((2_000_000 * (n - 5) // (x + y), x, y) for x, y in ((n, n - 4), (n - 2, n - 1))), key=lambda t: t[0])
    kept = phrases.uncovered(spark.createDataFrame([("en", "a b", 5), ("en", "b c", 10), ("en", "a b c", 4)], "lang string, phrase string, a long"))
    assert {r.phrase for r in kept.collect()} == {"b c", "a b c"}


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    assert oracle.compare(spark, oracle.connect(sf), sf, queries.QUERIES["op11_prefix_growth"], queries.ORACLES["op11_prefix_growth"]) == ""
