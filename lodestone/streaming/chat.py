"""Events of chat answers as an ordered stream: phases, tool calls, answer tokens, references.

Producers number the events of a thread from 0; delivery may repeat events and change their order. A keyed state machine
puts them out in order, each once: an event ahead of a gap is held until the gap closes or has been open for WAIT of event
time, then the gap is told as an event of its own and the stream goes on. A thread that is silent for IDLE is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Kinds of events (fixed values); a gap is told by the stream itself.
PHASE, TOOL, TOKEN, REFERENCES, GAP = "phase", "tool_call", "token", "references", "gap"
#: Milliseconds that a gap may stay open, and after which a silent thread is forgotten; how late an event may come.
WAIT, IDLE, LATE = 30_000, 3_600_000, "10 minutes"
#: The session setting that the stream needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_OUT = "thread_id string, seq long, type string, payload string, missing long"


class InOrder(StatefulProcessor):
    """State of a thread: the next number, the time of its newest event, the open gap's deadline, and what is held behind it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, newest long, deadline long")
        self.held = handle.getMapState("held", "seq long", "ts long, type string, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following, newest, deadline = self.at.get() if self.at.exists() else (0, 0, 0)
        for frame in rows:
            for seq, ts, kind, payload in zip(frame["seq"], frame["ts"], frame["type"], frame["payload"], strict=True):
                when = int(pd.Timestamp(ts).value // 1_000_000)
                newest = max(newest, when)
                if seq >= following and not self.held.containsKey((int(seq),)):
                    self.held.updateValue((int(seq),), (when, kind, payload))
        out, following = self._drain(key[0], following)
        yield from self._settle(out, following, newest, deadline)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.at.exists():
            return
        following, newest, deadline = self.at.get()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        if fired == newest + IDLE:
            for k in list(self.held.keys()):
                self.held.removeKey(k)
            self.at.clear()
        elif fired == deadline:
            ahead = min(k[0] for k in self.held.keys())
            out = [(key[0], following, GAP, None, ahead - following)]
            more, following = self._drain(key[0], ahead)
            yield from self._settle(out + more, following, newest, 0)

    def close(self) -> None:
        pass

    def _drain(self, thread: str, following: int) -> tuple[list[tuple], int]:
        """Events that are next, in order; the number after them."""
        out = []
        while self.held.containsKey((following,)):
            _, kind, payload = self.held.getValue((following,))
            self.held.removeKey((following,))
            out.append((thread, following, kind, payload, 0))
            following += 1
        return out, following

    def _settle(self, out: list[tuple], following: int, newest: int, deadline: int) -> Iterator[pd.DataFrame]:
        """Set the state and its timers: one for silence, one for the oldest event behind an open gap."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        waiting = [v[0] for v in self.held.values()]
        deadline = (deadline if deadline and not out else min(waiting) + WAIT) if waiting else 0
        self.at.update((following, newest, deadline))
        self.handle.registerTimer(newest + IDLE)
        if deadline:
            self.handle.registerTimer(deadline)
        yield pd.DataFrame(out, columns=["thread_id", "seq", "type", "payload", "missing"])


def ordered(events: DataFrame) -> DataFrame:
    """Streaming events (thread_id, seq, ts, type, payload) of each thread in order, each number once; gaps that stayed open
    are rows of type `gap` with how many numbers are `missing`. The session needs the setting STORE."""
    named = events.select(F.col("thread_id").cast("string"), F.col("seq").cast("long"), "ts", "type", "payload").withWatermark("ts", LATE)
    return named.groupBy("thread_id").transformWithStateInPandas(statefulProcessor=InOrder(), outputStructType=_OUT, outputMode="append", timeMode="eventtime")


def ordered_batch(events: DataFrame) -> DataFrame:
    """The rows of ordered() for a whole table of events: of repeated numbers one, gaps told once."""
    once = events.select(F.col("thread_id").cast("string"), F.col("seq").cast("long"), "type", "payload").dropDuplicates(["thread_id", "seq"])
    before = F.coalesce(F.lag("seq").over(_by_thread()), F.lit(-1))
    told = once.withColumn("before", before)
    gaps = told.where("seq > before + 1").select("thread_id", (F.col("before") + 1).alias("seq"), F.lit(GAP).alias("type"), F.lit(None).cast("string").alias("payload"), (F.col("seq") - F.col("before") - 1).alias("missing"))
    return told.select("thread_id", "seq", "type", "payload", F.lit(0).cast("long").alias("missing")).unionByName(gaps)


def _by_thread():
    from pyspark.sql import Window

    return Window.partitionBy("thread_id").orderBy("seq")


def answers(rows: DataFrame) -> DataFrame:
    """One row a thread from ordered rows: answer (tokens joined), events, tool_calls, phase (the last one), references (the
    last), missing. A thread's events are those of one answer."""
    token = F.when(F.col("type") == TOKEN, F.struct("seq", F.col("payload").alias("p")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(token)), lambda x: x["p"]), "")
    last = lambda kind: F.max_by(F.when(F.col("type") == kind, F.col("payload")), F.when(F.col("type") == kind, F.col("seq")))
    count = lambda kind: F.count(F.when(F.col("type") == kind, 1))
    return rows.groupBy("thread_id").agg(text.alias("answer"), F.count(F.when(F.col("type") != GAP, 1)).alias("events"), count(TOOL).alias("tool_calls"), last(PHASE).alias("phase"), last(REFERENCES).alias("references"), F.sum("missing").alias("missing"))
