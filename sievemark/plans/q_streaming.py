"""Queries: streams over `events`, run to the end of the given files, and their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import folder
from ..streaming import ledgers as L
from ..streaming.keyed import KeyedSink
from ..streaming.stateful import budget_stream, coverage_stream, rocks
from . import views as V
from .q_metrics import rounded
from .registry import query


def stream(spark, d: str) -> DataFrame:
    t = V.table(spark, d, "events")
    return spark.readStream.schema(t.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def finished(df: DataFrame) -> DataFrame:
    """What an appending stream gives once all present input is read."""
    spark, path = df.sparkSession, folder(df.sparkSession, "stream")
    out = df.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", folder(spark, "progress"))
    out.format("parquet").option("path", path).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def upserted(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keyed table that a stream in update mode leaves once all present input is read."""
    spark = df.sparkSession
    sink = KeyedSink(folder(spark, "keyed"), keys)
    df.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", folder(spark, "progress")).foreachBatch(sink.upsert).start().awaitTermination()
    return sink.read(spark)


@query("t1_ingest_ledger", "SELECT user_id, event_type FROM events GROUP BY ALL")
def _(spark, d):
    return finished(L.ingest_ledger(stream(spark, d), ["user_id", "event_type"]).select("user_id", "event_type"))


@query("t1_first_rows", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def _(spark, d):
    return L.first_rows(V.table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("t2_done_jobs", "SELECT user_id, bool_or(value >= 40) AS done, count(*) AS attempts FROM events GROUP BY user_id")
def _(spark, d):
    jobs = L.done_jobs(stream(spark, d).withColumn("error", F.when(F.col("value") < 40, "low")), "user_id", "error", "ts")
    return L.all_windows(upserted(jobs, ["user_id", "start"]), "user_id")


_CUT = "SELECT event_id, round(coalesce(spent, 0), 4) AS spent, coalesce(spent, 0) < 500 AS allowed FROM (SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent FROM events)"


@query("t3_budget_stream", _CUT)
def _(spark, d):
    """The cut on a stream, with the state of each account."""
    rocks(spark)
    return rounded(finished(budget_stream(stream(spark, d).select("event_id", "user_id", "value"), "user_id", "event_id", "value", 500.0)).select("event_id", "spent", "allowed"), 4)


@query("t3_budget_cut", _CUT)
def _(spark, d):
    return rounded(L.budget_cut(V.table(spark, d, "events"), "user_id", "event_id", "value", 500.0).select("event_id", "spent", "allowed"), 4)


@query("t3_budget_totals", "SELECT user_id, round(sum(value), 4) AS spent, sum(value) < 500 AS open FROM events GROUP BY user_id")
def _(spark, d):
    return rounded(upserted(L.budget_totals(stream(spark, d), "user_id", "value", 500.0), ["user_id"]), 4)


@query("t4_bind_latest", "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(spark, d):
    windows = L.bind_latest(stream(spark, d), ["user_id"], "event_id", ["event_type"], "ts", "1 hour")
    return L.bind_latest(upserted(windows, ["user_id", "start"]), ["user_id"], "event_id", ["event_type"])


@query("t4_bind_windowed")
def _(spark, d):
    """Appended as the watermark passes: windows still open at the end are not among them."""
    return finished(L.bind_latest(stream(spark, d), ["user_id"], "event_id", ["event_type"], "ts", "1 hour"))


@query("t4_stale_bindings", "SELECT user_id, count(*) - count(*) FILTER (g = m) AS stale FROM (SELECT user_id, event_id // 100 AS g, max(event_id // 100) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def _(spark, d):
    return L.stale_bindings(V.table(spark, d, "events").withColumn("g", F.floor(F.col("event_id") / 100)), ["user_id"], "g")


_COVERAGE = """SELECT c_custkey AS user_id, CASE WHEN s IS NULL THEN 'missing' ELSE 'not terminal' END AS problem FROM customer LEFT JOIN (SELECT user_id, max_by(event_type, event_id) AS s FROM events GROUP BY user_id) ON user_id = c_custkey
    WHERE s IS NULL OR s NOT IN ('purchase', 'click')"""


@query("t5_state_coverage", _COVERAGE)
def _(spark, d):
    e = V.table(spark, d, "events").select("user_id", F.col("event_type").alias("state"), F.col("event_id").alias("seq"))
    return L.state_coverage(V.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), e, ["user_id"], ["purchase", "click"])


@query("t5_coverage_stream", _COVERAGE)
def _(spark, d):
    """Keys are declared long before the events, so their time is over when the watermark follows the last event."""
    rocks(spark)
    schema = V.table(spark, d, "customer").schema
    declared = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/customer.parquet*").select(F.col("c_custkey").alias("user_id"), F.lit("2000-01-01").cast("timestamp").alias("ts"))
    states = stream(spark, d).select("user_id", "ts", F.col("event_type").alias("state"), F.col("event_id").alias("seq"))
    closing = states.withColumns({"ts": F.col("ts") + F.expr("interval 30 days"), "user_id": -1 - F.col("seq") % 1000, "state": F.lit("end")})  # time goes on after the last event, for a thousand keys that no one declared
    return finished(coverage_stream(declared, states.unionByName(closing), "user_id", ["purchase", "click"], "ts", "1 hour", "1 day"))
