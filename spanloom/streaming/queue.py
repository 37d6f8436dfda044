"""Resumable work on streams: each key is done once, tried a bounded number of times, then given up."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout


def pending(items: DataFrame, done: DataFrame, failures: DataFrame, attempts: int = 5) -> DataFrame:
    """Items whose key is neither done nor failed as often as allowed."""
    spent = failures.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= attempts)
    return items.join(done.select("key").distinct(), "key", "left_anti").join(spent.select("key"), "key", "left_anti")


def status(items: DataFrame, done: DataFrame, failures: DataFrame, attempts: int = 5) -> DataFrame:
    """One row: total, completed, abandoned, remaining, and the run's state."""
    d = done.select("key").distinct().withColumn("d", F.lit(1))
    f = failures.groupBy("key").agg(F.count("*").alias("f"))
    rows = items.select("key").distinct().join(d, "key", "left").join(f, "key", "left")
    completed, given_up = F.col("d").isNotNull(), F.col("d").isNull() & (F.col("f") >= attempts)
    out = rows.agg(F.count("*").alias("total"), F.count_if(completed).alias("completed"), F.count_if(given_up).alias("abandoned"))
    left = F.col("total") - F.col("completed") - F.col("abandoned")
    return out.withColumn("remaining", left).withColumn("state", F.when(left > 0, "partial").when(F.col("abandoned") > 0, "complete_with_failures").otherwise("complete"))


def work(items: DataFrame, process: Callable[[str, str], str], attempts: int = 5, groups: int = 1 << 14) -> DataFrame:
    """key, attempt, result, error, abandoned of a stream of (key, payload, ...).

    State holds for each key how often it failed and whether it is done; keys that are done or given up give no rows when
    they come again, also after a restart from the checkpoint.

    A call of Python costs milliseconds, so keys share one of ``groups`` states by their hash: calls are bounded by the groups, not by the
    keys. A batch rewrites the states that it touches. ``groups`` must stay the same for a checkpoint.
    """

    def step(_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failed = dict(zip(*state.get, strict=True)) if state.exists else {}  # -1: done or given up
        for pdf in batches:
            rows = []
            for key, payload in zip(pdf["key"], pdf["payload"], strict=True):
                n = failed.get(key, 0)
                if n < 0:
                    continue
                try:
                    rows.append((key, n + 1, process(key, payload), None, False))
                    failed[key] = -1
                except Exception as e:  # noqa: BLE001
                    over = n + 1 >= attempts
                    rows.append((key, n + 1, None, f"{type(e).__name__}: {e}", over))
                    failed[key] = -1 if over else n + 1
            if rows:
                yield pd.DataFrame(rows, columns=["key", "attempt", "result", "error", "abandoned"])
        state.update((list(failed.keys()), list(failed.values())))

    return items.select("key", "payload", F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group")).groupBy("group").applyInPandasWithState(
        step, "key string, attempt int, result string, error string, abandoned boolean", "keys array<string>, failed array<int>", "append", GroupStateTimeout.NoTimeout
    )


def once(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark; state older than that is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> None:
    """Process all that is there, in bounded batches, exactly once, and stop."""
    stream.writeStream.format(kind).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()


def with_restarts(run: Callable[[], None], healthy: Callable[[], bool], restart: Callable[[], None], most: int = 3, wait: float = 5.0) -> int:
    """Run a query until it ends; returns how often it was started again.

    A failure with a healthy service is an error of the query and is raised. Otherwise the service is restarted, with twice the
    pause each time, and the query goes on from its checkpoint: what is done stays done.
    """
    for turn in range(most + 1):
        try:
            run()
            return turn
        except Exception:
            if healthy() or turn == most:
                raise
            time.sleep(wait * 2**turn)
            restart()
    return most


class Progress(StreamingQueryListener):
    """Rows so far, rate and remaining seconds of queries with a known number of items."""

    def __init__(self, total: int):
        self.total, self.rows, self.rate = total, 0, 0.0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.rate = event.progress.processedRowsPerSecond or self.rate

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    @property
    def remaining(self) -> float | None:
        return (self.total - self.rows) / self.rate if self.rate else None


def event_windows(stream: DataFrame, at: str, length: str, delay: str, *keys: str) -> DataFrame:
    """Counts by window of event time; late rows beyond the delay are dropped."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, length), *keys).agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "n")


def sessions(stream: DataFrame, at: str, gap: str, delay: str, *keys: str) -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", *keys, "n")
