import random

import numpy as np

from lodestone.operators import recall, textindex


def _chunks(spark, n=700, seed=4):
    rng = random.Random(seed)
    bits = ["the", "THE", "on", "person", "onion", "a", "aa", "aaa", "x-y", "ß", "été", "策略文件", "..", "don't", "seldomword"]
    rows = [(rng.randint(0, 10**12), rng.choice([None, "", " ".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))]), "doc") for _ in range(n)]
    rows = list({r[0]: r for r in rows}.values())
    return spark.createDataFrame(rows, "chunk_id long, content string, heading string")


def _queries(spark):
    return spark.createDataFrame([(1, "the on aa"), (2, "THE the a"), (3, "nothing-of-it"), (4, None), (5, "été 策略 ß"), (6, " ")], "query_id long, query_text string")


def test_search_is_text_recall(spark):
    chunks, queries = _chunks(spark), _queries(spark)
    index = textindex.build(chunks, block=100, buckets=4)
    for k in (5, 40):
        want = sorted(map(tuple, recall.text_recall(chunks, queries, k).collect()))
        assert sorted(map(tuple, textindex.search(spark, index, queries, k).collect())) == want and want
    assert textindex.search(spark, index, queries.limit(0), 5).count() == 0
    textindex.drop(spark, index)


def test_search_reads_postings_only(spark):
    index = textindex.build(_chunks(spark), block=100, buckets=4)
    found = textindex.search(spark, index, _queries(spark), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    files = set(found.inputFiles())
    assert files and all("/text_index_" in f for f in files)
    assert "hashpartitioning(block" not in plan  # blocks are where their bucket is
    textindex.drop(spark, index)


def test_lexicon(spark):
    chunks = spark.createDataFrame([(1, "a b a"), (2, "B c"), (3, None)], "chunk_id long, content string")
    index = textindex.build(chunks)
    assert {tuple(r) for r in index.words(spark).collect()} == {("a", 1, 2), ("b", 2, 2), ("c", 1, 1)}
    assert {tuple(r) for r in textindex.matching_words(index.words(spark), ["a", "c"]).collect()} == {("a", 0, 1), ("c", 1, 1)}
    textindex.drop(spark, index)
    empty = textindex.build(chunks.limit(0))
    assert textindex.search(spark, empty, _queries(spark), 3).count() == 0
    textindex.drop(spark, empty)


def test_large_question_sets_go_in_blocks(spark, monkeypatch):
    chunks = _chunks(spark, 200)
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["the on", "a aa", "x-y", "person", "onion the", "été", "策略", "don't", "seldomword a"])], "query_id long, query_text string")
    want = sorted(map(tuple, recall.text_recall(chunks, queries, 4).collect()))
    vectors = chunks.selectExpr("chunk_id", "array(pmod(chunk_id, 7) - 3D, pmod(chunk_id, 5) - 2D) AS embedding")
    asked = queries.selectExpr("query_id", "array(query_id + 1D, 3D - query_id) AS embedding")
    near = sorted(map(tuple, recall.vector_recall(vectors, asked, 4).collect()))
    index = textindex.build(chunks, block=50, buckets=2)
    monkeypatch.setattr(recall, "QUERY_BLOCK", 4)
    monkeypatch.setattr(textindex, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, recall.text_recall(chunks, queries, 4).collect())) == want
    assert sorted(map(tuple, recall.vector_recall(vectors, asked, 4).collect())) == near
    assert sorted(map(tuple, textindex.search(spark, index, queries, 4).collect())) == want
    textindex.drop(spark, index)


def test_text_recall_sends_the_best_of_a_task_only(spark):
    """k rows a query and task, however many batches and parts it reads; texts of any length are counted in bounded steps."""
    rows = [(i, "aa" * (i % 7) + " the aaaa that thathat " + "...." * (i % 3)) for i in range(3000)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string").coalesce(1)
    queries = spark.createDataFrame([(1, "aa that .. THE"), (2, "aaa"), (3, "thathat a")], "query_id long, query_text string")
    got = recall.text_scores(chunks, queries, k=4).collect()
    assert len(got) == 3 * 4
    want = sorted((q, -sum(x.lower().count(t) for t in text.lower().split()), i) for q, text in queries.collect() for i, x in rows)
    best = [r for q in (1, 2, 3) for r in [w for w in want if w[0] == q][:4]]
    assert sorted((r.query_id, -r.score, r.chunk_id) for r in got) == best
    assert len(recall.text_scores(chunks, queries).collect()) == sum(s < 0 for _, s, _ in want)


def test_texts_are_counted_in_steps(spark, monkeypatch):
    """Whatever the steps of matches, counts are those of str.count."""
    every = ["a", "aa", "aba", "b", "that", "é", "xy", "éé", "th"]
    rng = random.Random(1)
    texts = ["".join(rng.choice("aab thé") for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["thathathat", "", "\u3000a\x0baa"]
    for step, tokens in ((1, every), (7, every), (1 << 20, every), (7, ["a", "aa"]), (7, ["that", "aba"])):
        monkeypatch.setattr(recall, "_CHARS", step)
        counter = recall.TokenCounter(tokens)
        for some in (texts, texts[:5], [""], texts):
            used, count = counter.counts(some)
            assert {tokens[u]: c.tolist() for u, c in zip(used, count, strict=True)} == {t: n for t in tokens if any(n := [x.count(t) for x in some])}


def test_index_is_built_from_texts_dealt_by_block(spark):
    """Postings of a block are made from its texts: few rows, many words each; no word row is shuffled."""
    chunks = spark.createDataFrame([(i % 2900, f"the w{i % 50} THE x{i} é{i % 9}") for i in range(3000)], "chunk_id long, content string")
    index = textindex.build(chunks, block=1000, buckets=2)
    rows = index.rows(spark)
    words = index.words(spark)
    assert rows.count() * 8 < words.count()  # a row a block and word before
    want = {}
    for i in range(3000):
        for w in f"the w{i % 50} the x{i} é{i % 9}".split():
            n, held = want.setdefault(w, [0, set()])
            want[w] = [n + 1, held | {i % 2900}]
    assert {tuple(r) for r in words.collect()} == {(w, len(held), n) for w, (n, held) in want.items()}
    textindex.drop(spark, index)


def test_texts_left_out_cannot_be_among_the_best():
    """reach() keeps every text that scores something and not less than the k-th best, however few the classes of characters."""
    rng = random.Random(3)
    bits = ["a", "aa", "aba", "b", "that", "hat", "at", "é", "xyz", "策略", "th"]
    for classes in (64, 3, 2):
        for _ in range(60):
            asked = [{t: rng.randint(1, 3) for t in rng.sample(bits, rng.randint(1, 6))} for _ in range(3)]
            texts = ["".join(rng.choice(["a", "b", "that", " ", "é", "xyz", "策略", "q\n"]) for _ in range(rng.randint(0, 12))) for _ in range(20)]
            score = np.array([[sum(n * x.count(t) for t, n in mine.items()) for x in texts] for mine in asked])
            least = np.array([rng.choice([0, 1, 3, 6]) for _ in asked])
            must = ((score > 0) & (score >= least[:, None])).any(axis=0)
            assert not (must & ~recall.ScoreBound(asked, classes).reach(texts, least)).any()
    bound = recall._bound([{"the": 1, "he": 1, "cat": 2}])
    assert bound.reach(["the cat", "the the", "cat", "", "dog"], np.array([3])).tolist() == [True, True, False, False, False]
    assert bound.reach(["the", "cat", "dog"], np.array([0])).tolist() == [True, True, False]
    assert recall._bound([{f"{i:03}": 1 for i in range(1000)}, *[{"a": 1}] * 10000]) is None
