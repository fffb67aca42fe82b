"""Streams of recorded calls: counts by window, latest generations, and call budgets as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tool_counts(calls: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window start, tool, n, mean latency; rows later than the watermark are dropped by Spark."""
    w = calls.withWatermark(time, late).groupBy(F.window(time, window), "tool").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean_latency_ms"))
    return w.select(F.col("window.start").alias("start"), "tool", "n", "mean_latency_ms")


def first_calls(calls: DataFrame, keys: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each call once, however often it is delivered within the watermark."""
    return calls.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def budget_stream(calls: DataFrame, run: str, total: int = 12, per_tool: int = 4, idle_ms: int | None = None) -> DataFrame:
    """run, idx, tool, allowed, reason: the budget gate over calls as they arrive; a run's state is its counters; with idle_ms it expires after
    so long without calls (such a query runs batches without data, so it doesn't end by itself).

    calls(run, idx, tool); within a batch calls count in the order of idx.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used: dict[str, int] = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("idx")
        out = []
        for idx, tool in zip(rows["idx"], rows["tool"], strict=True):
            used[""] = used.get("", 0) + 1
            used[tool] = used.get(tool, 0) + 1
            reason = "total" if used[""] > total else "per_tool" if used[tool] > per_tool else None
            out.append((key[0], idx, tool, reason is None, reason))
        state.update((list(used), list(used.values())))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[run, "idx", "tool", "allowed", "reason"])

    kind = dict(calls.dtypes)[run]
    return calls.groupBy(run).applyInPandasWithState(step, f"{run} {kind}, idx long, tool string, allowed boolean, reason string", "tools array<string>, counts array<long>", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def keep_latest(log: DataFrame, path: str, checkpoint: str):
    """A running query that keeps, in a folder for each batch, the newest record of every key: (key, completion, ord)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("key").agg(F.max_by(F.struct("completion", "ord"), "ord").alias("r")).select("key", "r.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
