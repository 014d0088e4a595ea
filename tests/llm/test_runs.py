import hashlib
import random
import re
import time
import zlib

import numpy as np

from lodestone.llm import queries, runs

SCHEMA = "doc_id long, text string, n_runs string, start int"


def brute_runs(words):
    """Every maximal stretch of every period, its smallest period tried one by one."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            end = j + q
            if j > i and end - i >= max(6, 4 * q):
                part = words[i:end]
                if not any(part[e:] == part[: len(part) - e] for e in range(1, q)):
                    out.append((i, end - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    tail = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *tail, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def sequences(k, seed):
    rng = random.Random(seed)
    for _ in range(k):
        n, v = rng.randint(0, 130), rng.choice([1, 2, 2, 3, 6])
        x = [rng.randrange(v) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 10:
                p, a = rng.randint(1, n // 5 + 1), rng.randrange(n)
                for i in range(a + p, min(n, a + p * rng.randint(3, 8) + rng.randint(0, p))):
                    x[i] = x[i - p]
        yield x


def test_find_is_brute_force():
    for x in sequences(1500, 1):
        assert [(r.start, r.length, r.period) for r in runs.find(np.array(x, np.int64))] == brute_runs(x), x


def test_repeats_of_repeats():
    unit = [1] * 7 + [2]
    x = unit * 5 + [3] + [1, 2] * 9 + [4] * 5 + [5] * 6
    assert [(r.start, r.length, r.period) for r in runs.find(np.array(x))] == brute_runs(x)
    assert runs.collapse("a " * 5) == "a a a a a"
    assert runs.collapse("x " + "a " * 6 + "y") == "x a y"
    assert runs.collapse("so it is " * 4 + "so it") == "so it is"


def test_long_texts_are_near_linear():
    a, b = [0], [0, 1]
    while len(b) < 60_000:
        a, b = b, b + a
    for x in ([0] * 400_000, [i % 3 for i in range(400_000)], [i % 70_000 for i in range(300_000)], [bin(i).count("1") % 2 for i in range(1 << 16)], b):
        began = time.process_time()
        found = runs.find(np.array(x))
        assert time.process_time() - began < 12
        assert len(found) <= 1
    assert runs.find(np.array([i % 70_000 for i in range(300_000)])) == [runs.Run(0, 300_000, 70_000)]


def test_rows(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "one", "a a a a a", "a a a a a a", "a\x0ba\x0ca\ra\na\ta", "é é é é é é b", "x\xa0y " * 8, "end " + "go on now " * 30 + "stop"]
    texts += [" ".join(f"w{i}" for i in x) for x in sequences(400, 3)]
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(None, "a b " * 9), (7, texts[7]), (7, texts[7]), (-3, "b " * 40)]
    docs += [(rng.choice([i for i in range(500, 4000) if zlib.crc32(str(i).encode()) % 10 == 0]), t) for t in texts]
    rows = spark.createDataFrame([(d, t, "z", 5) for d, t in docs], SCHEMA)
    got = [tuple(r) for r in runs.periodic_runs(rows, plant=True).select("doc_id", *runs._COLUMNS).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1], r[-2])
    assert sorted(got, key=key) == sorted((brute(d, t) for d, t in docs), key=key)
    assert runs.periodic_runs(rows.limit(0)).count() == 0


def test_spans_and_collapsed_texts(spark):
    rows = spark.createDataFrame([(1, "say hey you " * 5 + "end", "n", 1), (2, None, "n", 1), (3, "plain   text", "n", 1)], SCHEMA)
    assert [tuple(r) for r in runs.run_spans(rows).collect()] == [(1, 0, 15, 3, "say hey you")]
    assert {r.doc_id: r.text for r in runs.collapse_runs(rows).collect()} == {1: "say hey you end", 2: None, 3: "plain   text"}
    assert runs.collapse_runs(rows).columns == rows.columns


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: brute(d.doc_id, d.text) for d in docs if len(d.text or "") < 6000}
    got = {r.doc_id: tuple(r[c] for c in ["doc_id", *runs._COLUMNS]) for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs) and {d: got[d] for d in want} == want
