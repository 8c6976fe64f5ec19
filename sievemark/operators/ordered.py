"""Orders over tables of any size, by ranges of sampled bounds: what needs a row's neighbours or its place looks at a part, and at a row for each part.

in_parts() deals rows to parts by Spark's range partitioning, whose bounds come from a sample of the keys themselves, of any type and shape,
and writes them, so a row never changes its part. No task holds more than a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

PART = "_part"


def in_parts(df: DataFrame, keys: list[Column | str], name: str = "parts", parts: int | None = None) -> DataFrame:
    """df with PART, written: parts follow each other in the order of keys. Rows of one key share a part, so keys should end in something that tells rows apart."""
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    return written(dealt.sortWithinPartitions(*keys).withColumn(PART, F.spark_partition_id()), name)


def attach(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """df with the columns of other, which has at most a row per key; null is a key like others."""
    if not by:
        return df.crossJoin(other)  # one row
    o = other.select(*[F.col(k).alias(f"_o_{k}") for k in by], *[c for c in other.columns if c not in by])
    return df.join(o, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in by]).drop(*[f"_o_{k}" for k in by])


def running(parts: DataFrame, by: list[str], keys: list[Column | str], values: dict[str, Column]) -> DataFrame:
    """parts with a column for each of values: its sum over the rows of the group that come before, in the order that in_parts() was given (by, then keys)."""
    rows = parts.withColumns({f"_v_{out}": v for out, v in values.items()})
    per = rows.groupBy(*by, PART).agg(*[F.sum(f"_v_{out}").alias(out) for out in values])
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row per group and part
    per = per.select(*by, PART, *[F.coalesce(F.sum(out).over(before), F.lit(0)).alias(f"_s_{out}") for out in values])
    own = Window.partitionBy(*by, PART).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({out: F.coalesce(F.sum(f"_v_{out}").over(own), F.lit(0)) for out in values})
    rows = attach(rows, per, [*by, PART]).withColumns({out: F.col(out) + F.col(f"_s_{out}") for out in values})
    return rows.drop(PART, *[f"{k}_{out}" for k in ("_v", "_s") for out in values])


def numbered(parts: DataFrame, by: list[str], keys: list[Column | str], out: str, start: int = 0) -> DataFrame:
    """parts with `out`: the place within the group in the order of keys, which in_parts() was given after the group's columns (or alone)."""
    return running(parts, by, keys, {out: F.lit(1)}).withColumn(out, F.col(out) + start)


def first_k(df: DataFrame, by: list[str], order: list[Column | str], k: int, item: Column, n: str = "n", out: str = "items") -> DataFrame:
    """(*by, n, items): the group's rows in truth, and its first k items in the order given. Spark's group limit leaves at most k rows of a group in each task before the shuffle
    (for k under spark.sql.optimizer.windowGroupLimitThreshold, 1,000), so a group of any size is counted and listed in bounded memory."""
    top = df.select(*by, item.alias("_i"), F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("_k")).where(F.col("_k") <= k)
    lists = top.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_i"))), lambda x: x["_i"]).alias(out))
    return attach(df.groupBy(*by).agg(F.count(F.lit(1)).alias(n)), lists, by)


def places(df: DataFrame, by: list[str], key: str, out: str, size: str = "_size") -> DataFrame:
    """df with `out`, the place by key within the group from 0, and `size`, the group's rows. Null keys come first; the order of equal keys is open."""
    parts = in_parts(df, [*by, key], "places")
    return attach(numbered(parts, by, [key], out), parts.groupBy(*by).agg(F.count(F.lit(1)).alias(size)), by)
