"""Structured Streaming: audit windows with watermarks, bounded conversation state, incremental ingestion."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def tumbling(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and key; rows later than ``late`` are dropped and their state forgotten."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def sliding(events: DataFrame, time: str, key: str, width: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width, step), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class _Conversation(StatefulProcessor):
    """The last turns of a conversation, until nothing was said for a while by event time."""

    def __init__(self, n: int, idle_ms: int):
        self.n, self.idle = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn long, text string")
        self.last = handle.getValueState("last", "at long")

    def _row(self, key: tuple, turns: list[tuple], closed: bool) -> pd.DataFrame:
        return pd.DataFrame({"conv_id": [key[0]], "turns": [[int(t) for t, _ in turns]], "texts": [[x for _, x in turns]], "closed": [closed]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [(t, x) for t, x in self.turns.get()] if self.turns.exists() else []
        last = self.last.get()[0] if self.last.exists() else 0
        for b in rows:
            held += list(zip(b["turn"].tolist(), b["text"].tolist(), strict=True))
            last = max(last, int(b["at"].max().timestamp() * 1000))
        held = sorted(held, key=lambda x: x[0])[-self.n :]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle)
        self.turns.put(held)
        self.last.update((last,))
        yield self._row(key, held, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [(t, x) for t, x in self.turns.get()]
        self.turns.clear()
        self.last.clear()
        yield self._row(key, held, True)

    def close(self) -> None:
        pass


def recent_turns(turns: DataFrame, n: int = 6, idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The last ``n`` turns of each conversation of a stream (conv_id, turn, text, at), kept as state: a row (conv_id, turns,
    texts, closed) for each batch that brings turns of it.  When the watermark says that a conversation has been idle for
    ``idle``, its row comes once more as ``closed``, and nothing is kept of it."""
    gap = turns.sparkSession.sql(f"SELECT cast(interval {idle} as interval second) AS i").first()["i"]
    step = _Conversation(n, int(gap.total_seconds() * 1000))
    by = turns.withWatermark("at", late).groupBy("conv_id")
    return by.transformWithStateInPandas(step, "conv_id long, turns array<long>, texts array<string>, closed boolean", "Update", "EventTime")


def keeps_state(spark):
    """A session's setting that state with timers needs, for queries that are started in this block."""
    return setting(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def setting(spark, name: str, value: str) -> Iterator[None]:
    """A session's setting inside a block; what it was before stands again behind it."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def ingest(spark, folder: str, handle, checkpoint: str):
    """Watches a folder and gives each batch of new files (path, content) to ``handle(batch, id)``; stops when none are left."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
