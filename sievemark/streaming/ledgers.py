"""Append-only logs as streams: ledgers, attempts, budgets and bindings. Each has a batch twin with the same result.

State is bounded by a watermark on event time: keys older than `delay` behind the newest event are let go, and rows that come later than that are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ingest_ledger(stream: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 day") -> DataFrame:
    """One row per key, the first to arrive; with a checkpoint, over restarts too. With an event time, only within the watermark's delay."""
    if time:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def first_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_k = 1").drop("_k")


def done_jobs(df: DataFrame, job: str, error: str = "error", time: str | None = None, delay: str = "1 day", window: str = "1 day") -> DataFrame:
    """(job, done, attempts): a success closes a job, errors leave it open. On a stream give an event time: then it is (job, start, done, attempts) by window of that time, in update mode,
    whose state goes with the watermark; all_windows() sums up what a keyed sink holds."""
    out = (F.bool_or(F.col(error).isNull()).alias("done"), F.count(F.lit(1)).alias("attempts"))
    if time:
        return df.withWatermark(time, delay).groupBy(job, F.window(time, window)).agg(*out).select(job, F.col("window.start").alias("start"), "done", "attempts")
    return df.groupBy(job).agg(*out)


def all_windows(windows: DataFrame, job: str) -> DataFrame:
    return windows.groupBy(job).agg(F.bool_or("done").alias("done"), F.sum("attempts").alias("attempts"))


def budget_cut(df: DataFrame, account: str, order: str, cost: str, bound: float) -> DataFrame:
    """df with spent (before the row) and allowed: whether the account's bound had not been reached yet."""
    w = Window.partitionBy(account).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("spent", F.coalesce(F.sum(cost).over(w), F.lit(0.0))).withColumn("allowed", F.col("spent") < bound)


def budget_totals(stream: DataFrame, account: str, cost: str, bound: float) -> DataFrame:
    """(account, spent, open), running."""
    return stream.groupBy(account).agg(F.sum(cost).alias("spent")).withColumn("open", F.col("spent") < bound)


def bind_latest(df: DataFrame, keys: list[str], generation: str, columns: list[str], time: str | None = None, delay: str = "1 day", window: str = "1 day") -> DataFrame:
    """Per key the columns of its latest generation. On a stream, per key and window of event time, so that old state can go."""
    latest = F.max_by(F.struct(generation, *columns), generation).alias("_b")
    if time:
        g = df.withWatermark(time, delay).groupBy(*keys, F.window(time, window)).agg(latest)
        return g.select(*keys, F.col("window.start").alias("start"), "_b.*")
    return df.groupBy(*keys).agg(latest).select(*keys, "_b.*")


def stale_bindings(df: DataFrame, keys: list[str], generation: str) -> DataFrame:
    """(keys, stale): how many results are not of the latest generation."""
    g = df.withColumn("_m", F.max(generation).over(Window.partitionBy(*keys)))
    return g.groupBy(*keys).agg(F.count_if(F.col(generation) < F.col("_m")).alias("stale"))


def state_coverage(expected: DataFrame, states: DataFrame, keys: list[str], terminal: list[str]) -> DataFrame:
    """(keys, problem): declared keys without a state, or whose last state is not a terminal one."""
    last = states.groupBy(*keys).agg(F.max_by("state", "seq").alias("_s"))
    j = expected.select(*keys).distinct().join(last, keys, "left")
    return j.withColumn("problem", F.when(F.col("_s").isNull(), "missing").when(~F.col("_s").isin(terminal), "not terminal")).where("problem is not null").drop("_s")
