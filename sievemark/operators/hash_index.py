"""A kept index of near-duplicate keys, so that new rows meet the protected set without banding or shuffling it again.

Keys and contents are two tables, bucketed by what they are looked up by; add() appends to them. A lookup reads the buckets as they are and shuffles only the new rows, as long as there are
at least as many buckets as spark.sql.shuffle.partitions; where the new rows are few, Spark broadcasts them instead, and its runtime filters skip what they can't meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .joins import keyed


class HashIndex:
    def __init__(self, spark: SparkSession, name: str, path: str, distance: int = 4, buckets: int = 256):
        """Opens the tables {name}_keys and {name}_contents at path, or makes them; distance and buckets must be those they were made with."""
        self.spark, self.distance, self.buckets = spark, distance, buckets
        self.keys, self.contents, self.path = f"{name}_keys", f"{name}_contents", path.rstrip("/")
        for table, columns, by in ((self.keys, "band INT, bits BIGINT, p STRING", "band, bits"), (self.contents, "content_sha256 STRING", "content_sha256")):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{self.path}/{table.rsplit('.', 1)[-1]}'")

    def _keys(self, df: DataFrame, name: str) -> DataFrame:
        ok = df.where(S.is_hex(F.col("phash"), 16)).select(F.lower("phash").alias(name)).distinct()
        return keyed(ok, name, self.distance).select("band", "bits", name)

    def add(self, protected: DataFrame) -> None:
        """Appends protected rows (phash, content_sha256). What is there already does no harm, but takes room."""
        rows = self._keys(protected, "p").repartition(self.buckets, "band", "bits")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "band", "bits").option("path", f"{self.path}/{self.keys.rsplit('.', 1)[-1]}").saveAsTable(self.keys)
        contents = protected.select("content_sha256").where("content_sha256 is not null").distinct().repartition(self.buckets, "content_sha256")
        contents.write.mode("append").format("parquet").bucketBy(self.buckets, "content_sha256").option("path", f"{self.path}/{self.contents.rsplit('.', 1)[-1]}").saveAsTable(self.contents)

    def decontaminate(self, df: DataFrame) -> DataFrame:
        """(sample_id, reason) of rows of df (sample_id, phash, content_sha256) too near to a row of the index; `exact` content goes before `near`."""
        exact = df.join(self.spark.table(self.contents), "content_sha256", "left_semi").select("sample_id", F.lit("exact").alias("reason"))
        met = self._keys(df, "q").join(self.spark.table(self.keys), ["band", "bits"]).where(S.hamming(F.col("q"), F.col("p")) <= self.distance).select("q").distinct()
        near = df.join(met, F.lower("phash") == F.col("q"), "left_semi").select("sample_id", F.lit("near").alias("reason"))
        return exact.unionByName(near).groupBy("sample_id").agg(F.min("reason").alias("reason"))
