"""CSV with line feeds in quotes, read by several tasks a file.

Spark splits the files by lines. A line begins a record where the quotes before it in its file are even; their number before a split is the sum over the splits before it, so a first pass counts
quotes and lines by split, and in the second one each split knows how it begins. Quotes may stand where RFC 4180 lets them: around a field, and doubled within.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, record): each record as text, and the number of its first line in its file, from 1. Blank lines are none."""
    t = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    t = t.withColumn("_i", F.monotonically_increasing_id())
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    per = t.groupBy("file", "split").agg(F.sum(quotes).alias("_q"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    starts = per.select("file", "split", F.coalesce(F.sum("_q").over(earlier), F.lit(0)).alias("_q0"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"))
    inside = Window.partitionBy("file", "split").orderBy("_i")
    t = t.withColumns({"_before": F.coalesce(F.sum(quotes).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_row": F.row_number().over(inside)})
    t = t.join(starts, ["file", "split"]).withColumns({"line": F.col("_n0") + F.col("_row"), "_begins": (F.col("_q0") + F.col("_before")) % 2 == 0})
    # The record of a line is the last one that began before it: in its split, or else the last of the splits before.
    own = F.max(F.when(F.col("_begins"), F.col("line"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    last = t.groupBy("file", "split").agg(F.max(F.when(F.col("_begins"), F.col("line"))).alias("_last"))
    carried = last.select("file", "split", F.max("_last").over(earlier).alias("_carried"))
    t = t.withColumn("_own", own).join(carried, ["file", "split"]).withColumn("_record", F.coalesce("_own", "_carried"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n")
    out = t.groupBy("file", F.col("_record").alias("line")).agg(F.regexp_replace(whole, "\r$", "").alias("record"))
    return out.where("record <> ''")


def read_quoted(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The columns of the header as text, with _file and _line of each record. All files must have the same header, as their first record."""
    rows = records(spark, path)
    heads = rows.groupBy("file").agg(F.min_by("record", "line").alias("record"), F.min("line").alias("line"))
    names = [r[0] for r in heads.select("record").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError("no header" if not names else f"headers differ: {names}")
    columns = next(csv.reader([names[0]]))
    schema = ", ".join(f"`{c}` string" for c in columns)
    parsed = rows.join(heads.select("file", "line"), ["file", "line"], "left_anti").withColumn("_r", F.from_csv("record", schema, {"escape": '"'}))
    return parsed.select("_r.*", F.col("file").alias("_file"), F.col("line").alias("_line"))
