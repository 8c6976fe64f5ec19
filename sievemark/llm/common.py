"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir.

    Where that is unset, a local session (as in tests) gets a temporary folder; on a cluster that would lose rows, so there is none.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of the group that come before (bucket, *order).

    A group may hold a third of all rows, so no window spans one: sums by bucket are taken first,
    a window over those few sums gives each bucket's start, and the window over rows spans a bucket only.
    """
    keys = [*group, bucket]
    first = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys)
        .agg(F.sum(value).alias("_bucket_sum"))
        .select(*keys, F.coalesce(F.sum("_bucket_sum").over(first), F.lit(0)).alias("_bucket_start"))
    )
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    s = starts.select(*[F.col(k).alias(f"_s_{k}") for k in keys], "_bucket_start")
    same = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]
    return (
        rows.join(s, same, "left")
        .withColumn(out, F.col(out) + F.col("_bucket_start"))
        .drop("_bucket_start", *[f"_s_{k}" for k in keys])
    )


def text_of(col: str = "text") -> Column:
    """A text as string; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def expanded(df: DataFrame, first: str, copies: str, out: str, step: int = 1 << 16) -> DataFrame:
    """df with `copies` rows for each of its rows, numbered from `first` on in `out`; in two steps, so that no array holds more than `step` numbers."""
    at = F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / step))
    upto = F.least(F.col("_step") * step + step, F.col(copies)) - 1
    return df.where(F.col(copies) > 0).withColumn("_step", F.explode(at)).withColumn(out, F.explode(F.sequence(F.col(first) + F.col("_step") * step, F.col(first) + upto))).drop("_step")
