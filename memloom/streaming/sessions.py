"""Streams of session logs: tailing, pairs with state, buffered counters, windows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memloom.sources.readers import LOG_SCHEMA


def tail_logs(spark: SparkSession, folder: str, *, files_per_batch: int = 100) -> DataFrame:
    """A stream of log entries; the checkpoint keeps what was read, broken lines count as read and are skipped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").text(folder)
    return lines.select(F.from_json("value", LOG_SCHEMA).alias("j")).select("j.*").filter("timestamp IS NOT NULL")


class PairProcessor:
    """Turns the messages of a session into (question, answer) pairs, keeping an unanswered question and the last turn as state."""

    OUTPUT = "session string, turn long, user_text string, assistant_text string"

    def __new__(cls):
        from pyspark.sql.streaming import StatefulProcessor

        class _Pairs(StatefulProcessor):
            def init(self, handle):
                self._state = handle.getValueState("pending", "turn long, text string, has boolean")

            def handleInputRows(self, key, rows, timer_values):
                last, text, has = self._state.get() if self._state.exists() else (-1, "", False)
                out = []
                for pdf in rows:
                    for turn, role, content in pdf[["turn", "role", "content"]].sort_values("turn", kind="stable").itertuples(index=False, name=None):
                        if turn <= last:
                            continue  # taken in before
                        last = turn
                        if role == "user":
                            text, has = (f"{text}\n{content}" if has else content), True
                        elif role == "assistant":
                            out.append((key[0], turn, text if has else "", content))
                            text, has = "", False
                self._state.update((int(last), text, bool(has)))
                yield pd.DataFrame(out, columns=["session", "turn", "user_text", "assistant_text"])

            def close(self):
                pass

        return _Pairs()


def stream_pairs(messages: DataFrame) -> DataFrame:
    """Pairs of a stream of messages (session, turn, role, content); messages sent again are ignored."""
    return messages.groupBy("session").transformWithStateInPandas(PairProcessor(), PairProcessor.OUTPUT, "append", "none")


def windowed_counts(events: DataFrame, time: str = "ts", *, size: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, end, event_type, n, value): tumbling or sliding counts with a watermark; for batches and streams alike."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    grouped = events.withWatermark(time, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "value")


def session_windows(events: DataFrame, key: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): bursts of events of a key with no gap longer than ``gap``."""
    s = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_per_bundle(rows: DataFrame, key: list[str], time: str, within: str = "7 days") -> DataFrame:
    """A stream without rows sent again within a time."""
    return rows.withWatermark(time, within).dropDuplicatesWithinWatermark(key)


def run_once(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Processes all that is there in micro-batches and ends; ``apply`` gets each batch and must be idempotent by its number."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None], debounce: str = "2500 milliseconds") -> StreamingQuery:
    """Processes what came every ``debounce``."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=debounce).start()


def debounced(changes: DataFrame, key: str, time: str, *, quiet: str = "2500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """(key, first, last, changes): bursts of changes of a key, each given out once ``quiet`` and ``late`` went by without one."""
    bursts = changes.withWatermark(time, late).groupBy(key, F.session_window(time, quiet).alias("w"))
    return bursts.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("changes")).select(key, "first", "last", "changes")


def counter_flush(path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that writes the batch's counts per id as one table named by its number, so that a batch run again overwrites its own."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.groupBy("id").agg(F.count("*").alias("n"), F.max("ts").alias("last")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return apply
