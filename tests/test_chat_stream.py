import random
from datetime import datetime, timedelta

from lodestone.streaming import chat

SCHEMA = "thread_id string, seq long, ts timestamp, type string, payload string"
START = datetime(2024, 1, 1)


def _events(threads, n, seed):
    rng = random.Random(seed)
    out = []
    for t in range(threads):
        for i in range(n):
            kind = "phase" if i in (0, n - 1) else "references" if i == 1 else "tool_call" if i % 7 == 3 else "token"
            out.append((f"t{t}", i, START + timedelta(seconds=i), kind, f"{t}.{i} "))
    again = out + rng.sample(out, len(out) // 3)
    rng.shuffle(again)
    return out, again


def _run(spark, folder, batches):
    spark.conf.set(*chat.STORE)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/b={i:03d}")
    got = []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    q = chat.ordered(stream).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/cp").foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.unset(chat.STORE[0])
    return got


def test_any_delivery_gives_the_batch_result(spark, tmp_path):
    events, again = _events(4, 24, 1)
    size = -(-len(again) // 3)
    got = _run(spark, str(tmp_path), [again[i : i + size] for i in range(0, len(again), size)])
    for t in range(4):
        assert [r[1] for r in got if r[0] == f"t{t}"] == list(range(24))  # in order, each once
    batch = chat.ordered_batch(spark.createDataFrame(again, SCHEMA))
    assert sorted(got) == sorted(map(tuple, batch.collect()))
    answers = {r.thread_id: r for r in chat.answers(batch).collect()}
    assert answers["t1"].answer == "".join(p for t, _, _, k, p in events if t == "t1" and k == "token")
    assert (answers["t1"].events, answers["t1"].phase, answers["t1"].references, answers["t1"].missing) == (24, "1.23 ", "1.1 ", 0)


def test_gaps_are_told_after_their_time(spark, tmp_path):
    row = lambda t, i, s: (t, i, START + timedelta(seconds=s), "token", f"{i}")
    lost = [row("a", 0, 0), row("a", 1, 1), row("a", 4, 4), row("a", 5, 5)]
    later = [row("b", 0, 3000)]
    got = _run(spark, str(tmp_path), [lost, later, [row("b", 1, 3001)], [row("a", 6, 3002)]])
    mine = [(r[1], r[2], r[4]) for r in got if r[0] == "a"]
    assert mine == [(0, "token", 0), (1, "token", 0), (2, "gap", 2), (4, "token", 0), (5, "token", 0), (6, "token", 0)]
    batch = chat.ordered_batch(spark.createDataFrame(lost, SCHEMA))
    assert {(r.seq, r.type, r.missing) for r in batch.collect()} == set(mine) - {(6, "token", 0)}
