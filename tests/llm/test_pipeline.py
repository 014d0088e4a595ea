import random
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import packing, quality, secrets, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = [a + b for a in "mon tel ran sik bol fer".split() for b in "ado ine ultra est oru".split()]
    make = lambda n: " ".join(rng.choice(vocab) + str(rng.randint(0, 99)) * (rng.random() < 0.3) for _ in range(n))
    rows = []
    for i in range(60):
        text = make(rng.randint(60, 900))
        rows.append((i, text))
        if i % 5 == 0:
            rows.append((1000 + i, text))
            rows.append((2000 + i, text + " tail"))
        if i % 7 == 0:
            rows[-1] = (rows[-1][0], rows[-1][1] + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"')
    rows += [(5000 + i, make(80).replace(" ", "%% ")) for i in range(60)]
    rows += [(7000, None), (7001, ""), (7002, "too short"), (7003, "again and again " * 60), (None, make(120))]
    docs = [(d, t, "en" if d else None, "src", None if t is None else len(t)) for d, t in rows]
    labels = [(d, 0 if d >= 5000 else 1, 0) for d, *_ in docs if d is not None and d < 6000]
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs + docs[:3], SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out, docs + docs[:3]


def test_stages_and_run(spark, folder):
    path, docs = folder
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality rules", "simhash near-dedup", "secret scans", "best-fit packing"]
    read = spark.read.parquet(f"{path}/documents.parquet")

    good = stage["quality rules"](spark, read, path)
    assert good.columns == read.columns
    want = []
    for r in docs:
        c = dict(zip(quality.COUNTS, quality.counts(r[1]), strict=True))
        base = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        if not base and "%% " not in r[1]:
            want.append(r)
    got = [tuple(r) for r in good.collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)

    one = [tuple(r) for r in stage["simhash near-dedup"](spark, good, path).collect()]
    groups = defaultdict(list)
    fps = [simhash.fingerprint(r[1]) for r in got]
    parent = list(range(len(got)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(got)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    for i, r in enumerate(got):
        groups[find(i)].append(r)
    assert sorted(one, key=key) == sorted((min(g, key=key) for g in groups.values()), key=key)

    clean = [tuple(r) for r in stage["secret scans"](spark, spark.createDataFrame(one, SCHEMA), path).collect()]
    assert len(clean) == len(one)
    before = {r[0]: r for r in one}
    for r in clean:
        assert not secrets.base_spans(r[1]) and r[4] == len(r[1])
        if not secrets.base_spans(before[r[0]][1]):
            assert r == before[r[0]]

    rows = corpus_pipeline.run(spark, path).collect()
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    want = sorted((r[0] is None, r[0] or 0, k, s, n) for r in clean for k, (s, n) in enumerate(packing.cut(len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1, 2048)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for seq in by.values():
        seq.sort()
        assert [o for o, _ in seq] == [0, *np.cumsum([n for _, n in seq])[:-1]] and sum(n for _, n in seq) <= 2048


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_edge_cases_of_every_stage(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and extra columns that clash with names used inside."""
    rng = random.Random(3)
    words = ["mon%d" % i for i in range(900)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    body = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(8)]
    schema = SCHEMA + ", __fp string, __row int, __count_n_words string, bucket string, `Bucket_` int, fp string, anchor string, piece string"
    extra = ("f", 1, "c", "b", 2, "p", "a", "q")
    rows = [(1, long, "en", "s", len(long)), (2, None, None, None, None), (3, "", "", "", 0), (None, body[0], "en", "s", 5), (4, body[1], "en", "s", 5), (4, body[1], "en", "s", 5), (5, body[2] + " password = abcdefghijkl", "en", None, 5), (6, body[2] + " password = abcdefghijkl", "en", "s", 5)]
    docs = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    for table, kind in (("labels", "doc_id long, quality int, toxic int, __fp string"),):
        spark.createDataFrame([(1, 1, 0, "x"), (None, 0, None, "x"), (4, None, 0, "x")], kind).write.parquet(f"{tmp_path}/{table}.parquet")
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality rules"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns and sorted(str(r.doc_id) for r in good.collect()) == ["1", "4", "4", "5", "6", "None"]
    one = stage["simhash near-dedup"](spark, docs, str(tmp_path))
    assert one.columns == docs.columns and sorted(str(r.doc_id) for r in one.collect()) == ["1", "2", "4", "5", "None"]
    clean = stage["secret scans"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    got = sorted(((str(r.doc_id), r.text, r.n_chars, r.fp) for r in clean.collect()), key=str)
    want = [(str(d), t if d not in (5, 6) else body[2] + " [SECRET]", None if t is None else len(t if d not in (5, 6) else body[2] + " [SECRET]"), "p") for d, t, *_ in rows]
    assert got == sorted(want, key=str)
    packed = stage["best-fit packing"](spark, docs, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    assert sum(r.length for r in packed) == total and len([r for r in packed if r.doc_id == 1]) > 30
