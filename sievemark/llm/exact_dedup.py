"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries find every digest that may hold more than 1/(k+1) of the rows. Their exact counts and
winners (at most k rows) are broadcast, so that rows of huge groups are settled map-side; all other digests have
less than 1/(k+1) of the rows each and use an ordinary shuffle.

Defined results: null text counts as empty; a null id sorts below every id; rows that tie in id (repeated rows)
are told apart by their place in the written digest table, so that exactly one row of each group stays;
an empty table gives an empty result; other columns are not read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, text_of, written

HEAVY = 255
"""k: counters of a Misra-Gries summary, and the bound on the rows that are broadcast."""


def misra_gries(counts: dict[bytes, int], k: int) -> dict[bytes, int]:
    """The summary cut to k counters: the (k+1)th largest count is taken from all."""
    if len(counts) <= k:
        return counts
    cut = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), -(k + 1))[-(k + 1)])
    return {d: c - cut for d, c in counts.items() if c > cut}


def _summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for x in pc.value_counts(batch.column(0)).to_pylist():
                counts[x["values"]] = counts.get(x["values"], 0) + x["counts"]
            counts = misra_gries(counts, k)
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array(counts.keys(), pa.binary()), "low": pa.array(counts.values(), pa.int64())}
        )

    return run


def heavy_digests(digests: DataFrame, k: int = HEAVY) -> DataFrame:
    """(digest, low) of at most k digests, with every digest of more than 1/(k+1) of the rows among them."""
    merged = (
        digests.select("digest")
        .mapInArrow(_summaries(k), "digest binary, low long")
        .groupBy("digest")
        .agg(F.sum("low").alias("low"))
        .orderBy(F.desc("low"), "digest")
        .limit(k + 1)
    )
    rank = F.row_number().over(Window.orderBy(F.desc("low"), "digest"))  # over k + 1 rows
    cut = F.max(F.when(F.col("_rank") == k + 1, F.col("low"))).over(Window.partitionBy())
    return merged.withColumn("_rank", rank).withColumn("_cut", F.coalesce(cut, F.lit(0))).where("low > _cut").select("digest", "low")


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, row) of every row, written to the shared folder; row tells repeated rows apart."""
    return written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(text_of(text_col), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )


def winners(digests: DataFrame, k: int = HEAVY) -> DataFrame:
    """(digest, keep, size) of the heavy digests, counted exactly: at most k rows."""
    found = F.broadcast(heavy_digests(digests, k).select("digest"))
    exact = digests.join(found, "digest", "left_semi").groupBy("digest").agg(
        F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("size")
    )
    return written(exact, "winners")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = HEAVY) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    table = digest_table(docs, id_col, text_col)
    heavy = F.broadcast(winners(table, k))
    split = table.join(heavy, "digest", "left")
    group = Window.partitionBy("digest")
    rest = table.join(heavy, "digest", "left_anti").select(
        "doc_id", "digest", "row",
        F.max(F.struct("doc_id", "row")).over(group).alias("keep"), F.count(F.lit(1)).over(group).alias("size"),
    )
    both = split.where("size is not null").select("doc_id", "digest", "row", "keep", "size").unionByName(rest)
    return both.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = HEAVY) -> DataFrame:
    """The rows of docs without the losers of each group of equal texts; the largest id stays.

    Losers of heavy groups go map-side, before the one shuffle that carries texts.
    """
    cols = docs.columns
    digest, keep, size, place = "__digest", "__keep", "__size", "__place"
    heavy = winners(digest_table(docs, id_col, text_col), k).select(
        F.col("digest").alias(digest), F.col("keep.doc_id").alias(keep), F.col("size").alias(size)
    )
    rows = docs.withColumn(digest, F.unhex(F.sha2(text_of(text_col), 256))).join(F.broadcast(heavy), digest, "left")
    rows = rows.where(F.col(size).isNull() | F.col(id_col).eqNullSafe(F.col(keep)))
    order = Window.partitionBy(digest).orderBy(F.col(id_col).desc_nulls_last())
    return rows.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*cols)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


ORACLE_SQL = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        WINDOW g AS (PARTITION BY text_sha256)
    """
}
