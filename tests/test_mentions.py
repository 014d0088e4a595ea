"""Document mentions against a comparison of every pair."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestone.functions.text import GENERIC_TERMS
from lodestone.operators import mentions

WORDS = "travel expense rules holiday security handbook summary report version guide annual plan of the a budget 2024 notes office team letter index".split()


def squeeze(t):
    return re.sub(r"\s+", " ", t).strip()


def normal(t):
    return squeeze(re.sub(r"[_\-./()\[\]{}]+", " ", t.lower()))


def tokens(t):
    return [x for x in dict.fromkeys(re.findall(r"[A-Za-z0-9][A-Za-z0-9._/-]*", squeeze(t).lower())) if x not in GENERIC_TERMS]


def specific(t):
    return " " in t.strip() or len(t.strip()) >= 8


def brute(queries, documents):
    """(query_id, document_id, score, strong, place) by scoring every document of the area."""
    areas = defaultdict(list)
    for area, d, f in documents:
        if area is not None and normal(f[:-3]):
            areas[area].append((d, f, normal(f[:-3]), {p for p in map(normal, re.split(r"[-_/]+", f[:-3])) if p}))
    out = set()
    for qid, area, raw in queries:
        q = squeeze(raw)
        q = (squeeze(re.sub(r"(?i)^\s*(?:compare|summarize|summary of|overview of)\s*", "", q)) or q).lower()
        docs = areas.get(area, []) if q else []
        frequency = Counter(t for *_, n, _ in docs for t in tokens(n))
        owners = Counter(p for *_, parts in docs for p in parts)
        found, mine = [], tokens(q)
        for d, f, name, parts in docs:
            theirs = tokens(name)
            shared = set(mine) & set(theirs)
            strong = q == name
            score = 1.0 if strong else 0.0
            if not strong and any(len(t) >= 4 for t in mine):
                if name in q and specific(name):
                    score, strong = 0.96, True
                if any(p in q and specific(p) and owners[p] == 1 for p in parts):
                    score, strong = max(score, 0.94), True
                if q in name and specific(q):
                    score = max(score, 0.86)
                if shared:
                    bonus = min(30, sum({1: 12, 2: 6}.get(frequency[t], 1) for t in shared)) / 100
                    score = max(score, min(1.0, 0.42 + 0.18 * len(shared) / min(len(mine), len(theirs)) + bonus))
            if round(score, 12) >= 0.68:
                found.append((-round(score, 12), f.lower(), d, strong))
        out |= {(qid, d, -s, strong, i) for i, (s, _, d, strong) in enumerate(sorted(found)[:5], 1)}
    return out


def made(seed, n):
    rng = random.Random(seed)
    docs = []
    for d in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.choice([1, 1, 2, 3, 4, 9, 14]))] + ([f"x{rng.randint(0, 200)}"] if rng.random() < 0.5 else [])
        docs.append((rng.choice(["a", "a", "a", "b", None]), d, rng.choice([" ", "-", "_", " "]).join(words) + ".md"))
    asks = []
    for i in range(n):
        name = rng.choice(docs)[2][:-3]
        name = rng.choice([name, normal(name), " ".join(rng.sample(normal(name).split(), len(normal(name).split()))), normal(name)[: rng.randint(3, 30)]])
        asks.append((i, rng.choice(["a", "a", "b", "c", None]), rng.choice(["", "summarize ", "Compare ", "what does ", "in "]) + name + rng.choice(["", " say", " and the security handbook of the office", ""])))
    return asks + [(n, "a", "  "), (n + 1, "a", "summarize")], docs + [("a", n + 5, docs[0][2]), ("b", n + 6, "--.md")]


def test_every_pair(spark):
    seen = set()
    for seed in (1, 2, 3):
        asks, docs = made(seed, 260)
        q = spark.createDataFrame(asks, "query_id long, area_id string, query_text string")
        d = spark.createDataFrame(docs, "area_id string, document_id long, file_name string")
        got = {(r.query_id, r.document_id, r.score, r.strong, r.place) for r in mentions.mention_scores(q, d).collect()}
        want = brute(asks, docs)
        assert got == want, (sorted(got - want)[:3], sorted(want - got)[:3])
        seen |= {x[2] for x in want}
    assert len(seen) > 6 and seen >= {0.86, 0.96, 1.0}


def test_pairs_do_not_grow_with_common_words(spark):
    """Names that share a word and differ in another meet only their own query."""
    docs = [("a", i, f"annual expense report{i:05d}x.md") for i in range(3000)]
    asks = [(i, "a", f"summarize annual expense report{i:05d}x") for i in range(3000)]
    q = spark.createDataFrame(asks, "query_id long, area_id string, query_text string")
    names, asked = mentions.canonical(spark.createDataFrame(docs, "area_id string, document_id long, file_name string")), mentions.asked(q)
    assert mentions.sharing(asked, names).count() == 3000
    assert mentions.holding(asked, mentions.phrases(names)).count() == 6000  # the name, and its only part
    assert mentions.held_by(asked, names).count() == 3000


def test_plan_stays_small(spark, tmp_path):
    """Names, queries and what each way finds are written once: one plan over all of them filled the driver."""
    from lodestone.plans import catalog

    spark.createDataFrame([(d, "src", "en", "some text") for d in range(20)], "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("mention_resolution", "mention_ranking", "mention_scope"):
        assert len(catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()) < 30_000  # 150,000 before


def test_pieces_that_may_be_phrases(spark):
    r = spark.createDataFrame([("ab cd e",), ("abcdefgh",), ("",)], "q string").select(mentions.pieces(F.col("q")).alias("p")).collect()
    every = ["ab cd e"[i:j] for i in range(7) for j in range(i + 3, 8)]
    assert sorted(r[0].p) == sorted({x for x in every if x == x.strip() and " " in x}) and r[1].p == r[2].p == []


def test_empty(spark):
    q = spark.createDataFrame([], "query_id long, area_id string, query_text string")
    d = spark.createDataFrame([], "area_id string, document_id long, file_name string")
    assert mentions.resolve_mentions(mentions.mention_scores(q, d)).count() == 0
