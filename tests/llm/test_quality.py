import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import quality

SCHEMA = "doc_id long, text string, n_words string, kept int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def texts():
    rng = random.Random(1)
    out = [None, "", " \n\t ", "one", "a b c", "a b c a b c", "a a a a", "x\nx\n x\nx\n\n\n", "é\x0bü  ## | <b>\r\nß ß ß\r\nß ß ß", "z\x85y\xa0w"]
    out += [" ".join(rng.choice(["a", "b", "c\n", "dé", "#"]) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    out += [" ".join(rng.choice(["w%d" % i for i in range(3000)]) for _ in range(4000)) + "\nend", "word " * 20_000]
    return out


def test_counts():
    for t in texts():
        assert quality.counts(t)[:5] == brute(t)


def test_query(spark):
    rng = random.Random(2)
    docs = [(i, t) for i, t in enumerate(texts())]
    clean = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet"]) + str(rng.randint(0, 999)) for _ in range(80))
    docs += [(1000 + i, clean() if i % 3 else clean().replace(" ", "%% ")) for i in range(300)]
    docs += [(None, clean()), (1001, docs[-299][1])]
    rows = spark.createDataFrame([(d, t, "9", 9) for d, t in docs], SCHEMA)
    labels = spark.createDataFrame([(1000 + i, 1 if i % 3 else 0) for i in range(300)] + [(None, 0), (5, None), (99999, 0)], "doc_id long, quality int")
    got = quality.judge(rows, labels).collect()
    assert len(got) == len(docs)
    want = Counter()
    for d, t in docs:
        b = brute(t)
        want[(d, *b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    for r in got:
        assert not (r.kept and r.base_failed)
        if r.doc_id is not None and r.doc_id >= 1000:
            assert r.kept == bool((r.doc_id - 1000) % 3)


def test_held_out_accuracy_and_expression(spark):
    rng = np.random.default_rng(3)
    n = 1500
    rows = {c: rng.integers(60, 2000, n) for c in quality.COUNTS}
    rows["word_chars"] = rows["n_words"] * 5
    share = np.where(np.arange(n) % 4 == 0, rng.uniform(0.2, 0.5, n), rng.uniform(0, 0.1, n))
    rows["n_symbols"] = (share * rows["word_chars"]).astype(int)
    bad = np.arange(n) % 4 == 0
    fit = np.arange(n) < 1000
    rules = quality.learn({k: v[fit] for k, v in rows.items()}, bad[fit])
    table = quality._feature_table(rows)
    hit = np.zeros(n, bool)
    for r in rules:
        hit |= quality._covered(r, table, n)
    assert (hit[~fit] == bad[~fit]).mean() > 0.97
    df = spark.createDataFrame([tuple(int(rows[c][i]) for c in quality.COUNTS) for i in range(n)], ", ".join(f"{c} long" for c in quality.COUNTS))
    got = [r[0] for r in df.select((quality.expression(rules) > 0).alias("x")).collect()]
    assert got == hit.tolist()


def test_without_classes(spark):
    assert quality.learn({c: np.zeros(0) for c in quality.COUNTS}, np.zeros(0, bool)) == []
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(spark.createDataFrame([], SCHEMA), empty).count() == 0
    got = quality.judge(spark.createDataFrame([(1, "a " * 30, "x", 1)], SCHEMA), empty).select("kept", F.col("rule")).collect()
    assert [tuple(r) for r in got] == [(False, 0)]
