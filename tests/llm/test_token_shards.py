import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from lodestone.llm import packing, token_shards

SCHEMA = "doc_id long, text string, slot int, shard string"


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 17, 64, 1000, 4097])
def test_permutation(size):
    index = np.arange(size)
    place = token_shards.permute(index, size)
    assert sorted(place.tolist()) == index.tolist()
    assert token_shards.restore(place, size).tolist() == index.tolist()
    if size > 100:
        assert (place != token_shards.permute(index, size, key=7)).mean() > 0.9
        assert abs(np.corrcoef(index, place)[0, 1]) < 0.1


def docs():
    rng = random.Random(4)
    out = [(i, " ".join(rng.choice(["alpha", "beta é", "gamma\n"]) for _ in range(rng.choice([0, 5, 100, 2500]))), 1, "x") for i in range(90)]
    return out + [(300, None, None, None), (301, "", 1, "x"), (None, "no id", 1, "x"), (5, "again", 1, "x"), (5, "again", 1, "x")]


def test_round_trip(spark, tmp_path):
    data = docs()
    table = spark.createDataFrame(data, SCHEMA).repartition(3)
    table.write.parquet(f"{tmp_path}/docs")
    index = token_shards.materialise(spark.read.parquet(f"{tmp_path}/docs"), out=f"file://{tmp_path}/shards", length=64, shard=40)
    rows = sorted(index.collect())
    assert [r.slot for r in rows] == list(range(len(rows)))
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    want, whole = Counter(), Counter()
    for d, t, *_ in data:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        whole[(d, tuple(ids))] += 1
        for k, s in enumerate(range(0, len(ids), 64)):
            want[(d, k, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u2").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    reader = token_shards.Reader(index.shards_path)
    read = list(reader.read())
    assert len(read) == len(reader) == len(rows) and reader.manifest["shards"] > 3 and reader.manifest["size"] == len(rows)
    for r, ids in zip(rows, read, strict=True):
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
    for at in (0, 1, 17, len(rows) - 1):
        assert [x.tolist() for x in reader.read(at, 40)] == [x.tolist() for x in read[at : at + 40]]
    by = defaultdict(list)
    for r, ids in zip(rows, read, strict=True):
        if r.doc_id not in (5,):
            by[r.doc_id].append((r.start, ids.tolist()))
    for d, parts in by.items():
        assert whole[(d, tuple(x for _, p in sorted(parts) for x in p))] == 1
    back = {r.slot: r.ids for r in token_shards.read_table(spark, index.shards_path).collect()}
    assert back == {i: x.tolist() for i, x in enumerate(read)}
    sizes = {p.stat().st_size for p in (tmp_path / "shards").glob("*.bin")}
    assert all(s % reader.manifest["stride"] == 0 for s in sizes)
    assert not [p for p in (tmp_path / "shards").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_slots_are_the_permutation_of_a_stable_order_in_any_layout(spark, tmp_path):
    data = docs()
    got = []
    for n, seed in ((1, 0), (3, 1), (7, 2)):
        rows = data[:]
        random.Random(seed).shuffle(rows)
        spark.createDataFrame(rows, SCHEMA).repartition(n).write.parquet(f"{tmp_path}/docs{n}")
        index = token_shards.materialise(spark.read.parquet(f"{tmp_path}/docs{n}"), length=64, shard=40)
        got.append(sorted((r.slot, r.doc_id, r.piece, r.ids_crc32) for r in index.collect()))
        reader = token_shards.Reader(index.shards_path)
    assert got[0] == got[1] == got[2]
    seen = {(d, p, c): s for s, d, p, c in got[0]}
    hashed = lambda t: xxhash.xxh64_intdigest((t or "").encode()) - (1 << 63)
    number, encoding = 0, packing.fast_encoding()
    for d, t, *_ in sorted(data, key=lambda r: (r[0] is None, r[0] or 0, hashed(r[1]))):
        ids = np.append(packing.token_ids(t, encoding), 0).astype("<u2")
        for k, s in enumerate(range(0, len(ids), 64)):
            slot = reader.slot(number)
            assert reader.number(slot) == number
            if d != 5:
                assert seen[(d, k, zlib.crc32(ids[s : s + 64].tobytes()))] == slot
            number += 1
    assert number == len(reader)


def test_very_long_text(spark):
    text = "long words and numbers 12345 " * 40_000
    index = token_shards.materialise(spark.createDataFrame([(1, text, 1, "x"), (2, "short", 1, "x")], SCHEMA))
    rows = sorted(index.collect())
    ids = [x for _, x in sorted(zip([r.start for r in rows if r.doc_id == 1], [x.tolist() for r, x in zip(rows, token_shards.Reader(index.shards_path).read(), strict=True) if r.doc_id == 1], strict=True))]
    assert [i for x in ids for i in x] == [*packing.token_ids(text, packing.fast_encoding()).tolist(), 0]


def test_order_follows_the_key(spark, tmp_path):
    spark.createDataFrame(docs(), SCHEMA).write.parquet(f"{tmp_path}/docs")
    table = spark.read.parquet(f"{tmp_path}/docs")
    order = lambda key: [(r.doc_id, r.piece) for r in sorted(token_shards.materialise(table, key=key).collect())]
    assert order(1) == order(1) != order(2)


def test_empty(spark):
    index = token_shards.materialise(spark.createDataFrame([], SCHEMA))
    assert index.count() == 0 and len(token_shards.Reader(index.shards_path)) == 0
