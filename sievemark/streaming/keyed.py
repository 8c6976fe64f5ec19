"""A keyed table that a stream in update mode writes: the last row of each key, whatever is replayed or restarted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedSink:
    """Each batch is written under its own id, so a batch that is run again replaces itself; a reader takes each key's row of the highest id.

    Every `compact` batches the table is written anew as one base, and what came before the base before it is removed: files stay as many as keys and recent batches need.
    Give upsert to foreachBatch; a batch has at most a row per key, as aggregates in update mode do.
    """

    def __init__(self, path: str, keys: list[str], compact: int = 50):
        self.path, self.keys, self.compact = path.rstrip("/"), keys, compact

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        if batch_id % self.compact == self.compact - 1:
            bases, batches = self._complete(spark)
            self.read(spark, batch_id).write.mode("overwrite").parquet(f"{self.path}/base={batch_id}")
            last = max((b for b in bases if b < batch_id), default=-1)  # readers of the base before may be at work
            fs, path = self._files(spark)
            for name in [f"base={b}" for b in bases if b < last] + [f"batch={b}" for b in batches if b <= last]:
                fs.delete(path(f"{self.path}/{name}"), True)

    def _files(self, spark: SparkSession):
        jvm = spark._jvm
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        return path(self.path).getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _complete(self, spark: SparkSession) -> tuple[list[int], list[int]]:
        """Ids of the bases and batches that were written to the end."""
        fs, path = self._files(spark)
        if not fs.exists(path(self.path)):
            return [], []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path)) if fs.exists(path(f"{s.getPath()}/_SUCCESS"))]
        of = lambda kind: sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))
        return of("base"), of("batch")

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The table; with `before`, as made without bases of that id or higher."""
        bases, batches = self._complete(spark)
        bases = [b for b in bases if before is None or b < before]
        base = max(bases, default=-1)
        tables = [spark.read.parquet(f"{self.path}/base={base}").withColumn("_b", F.lit(-1))] if bases else []
        tables += [spark.read.parquet(f"{self.path}/batch={b}").withColumn("_b", F.lit(b)) for b in batches if b > base]
        if not tables:
            raise FileNotFoundError(f"no batch has been written to {self.path}")
        rows = tables[0]
        for t in tables[1:]:
            rows = rows.unionByName(t)
        rest = [c for c in rows.columns if c not in self.keys and c != "_b"]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_b").alias("_r")).select(*self.keys, "_r.*")
