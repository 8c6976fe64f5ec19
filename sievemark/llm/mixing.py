"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

Every source's documents are shuffled by hash into one stream of words, which is cut into blocks of equal words.
A van der Corput sequence gives the order of the mix: point n, the bit-reversed n, falls into one source's
interval of the cumulative weights, and the r-th slot of a source takes the r-th block of its stream. The first 2^k points hold one
point in each cell of width 2^-k, so a source gets its share of slots within one, and any prefix of the schedule is balanced too.
Which words are taken, and when, follows from the slots: each document carries the first slot that takes words of it.

Defined results: null text has size 0 and takes nothing; null source is a source of its own, last in order; repeated rows are
documents of their own; an empty table, or one without words, takes nothing; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, expanded, running_sum, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK_WORDS = 2048
BUCKETS = 4096
CELL_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(source, doc_id, size, copies): repeated rows are counted, so that they can't gather in one task."""
    return (
        docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"))
        .groupBy("source", "doc_id", "size")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): one row per source.

    A source's target is min(most * size, level * weight). That is where resharing the excess of full sources
    by weight ends; in order of most * size / weight the level follows from sums over the sources that come before.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    per = per.withColumn("_place", place).withColumn("_w", w).withColumn("_cap", F.col("source_size") * most)
    every = Window.partitionBy()
    before = Window.orderBy("_ratio", "_place").rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_left", F.sum("source_size").over(every) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weight", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    )
    # The first source whose cap isn't reached sets the level; those before it are full.
    per = per.withColumn("_level", F.col("_left") / F.col("_weight"))
    level = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_place", "_level"))).over(every)["_level"]
    return per.withColumn("_level", level).select(
        "source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target")
    )


def schedule(goals: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source, rank): the order of the mix. Slots are few: one for each block_words words of it."""
    spark = goals.sparkSession
    quotas = goals.select(
        "source",
        # Blocks of whole epochs, and those of the last, cut one.
        (
            F.floor(F.round("target") / F.greatest("source_size", F.lit(1))) * F.ceil(F.col("source_size") / block_words)
            + F.ceil((F.round("target") % F.greatest("source_size", F.lit(1))) / block_words)
        ).cast("long").alias("quota"),
    ).where("quota > 0")
    total = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    bits = max(CELL_BITS, math.ceil(math.log2(max(1, 2 * total))))  # twice as many points: every source reaches its quota
    points = 1 << bits
    upto = F.sum("quota").over(Window.orderBy(F.col("source").asc_nulls_last()))
    cell = points >> CELL_BITS
    bounds = (
        quotas.withColumn("_hi", F.floor(upto * F.lit(points) / F.lit(max(1, total))).cast("long"))
        .withColumn("_lo", F.coalesce(F.lag("_hi").over(Window.orderBy(F.col("source").asc_nulls_last())), F.lit(0)))
        .where("_hi > _lo")
        .withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / cell), F.floor((F.col("_hi") - 1) / cell))))
    )
    turned = F.conv(F.reverse(F.lpad(F.bin(F.col("id")), bits, "0")), 2, 10).cast("long")
    slots = spark.range(points if total else 0).select(F.col("id").alias("slot"), turned.alias("_v")).withColumn("_cell", F.floor(F.col("_v") / cell))
    hit = slots.join(bounds, "_cell").where("_v >= _lo and _v < _hi").select("slot", "source", "quota", F.lit(1).alias("_one"))
    hit = hit.withColumn("_part", F.floor(F.col("slot") / 65536))
    return running_sum(hit, ["source"], "_part", ["slot"], "_one", "rank").where("rank < quota").select("slot", "source", "rank")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, first_slot (null where nothing is taken); in the order of first_slot the documents are mixed."""
    sizes = written(sized(docs, id_col, text_col, source_col), "sizes")
    goals = written(targets(sizes), "goals")
    slots = schedule(goals, block_words)
    g = goals.select(F.col("source").alias("_source"), "source_size", "target")
    n_blocks = F.ceil(F.col("source_size") / block_words)
    # What each slot takes: block `block` of epoch `epoch`, the last one cut at the target.
    takes = (
        slots.join(g, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("epoch", F.floor(F.col("rank") / n_blocks))
        .withColumn("block", F.col("rank") % n_blocks)
        .withColumn("_start", F.col("block") * block_words)
        .withColumn("_end", F.least(F.col("_start") + block_words, F.col("source_size"), F.round("target").cast("long") - F.col("epoch") * F.col("source_size")))
        .where("_end > _start")
        .select(F.col("source").alias("_source"), F.col("block").alias("_block"), "_start", "_end", "slot")
    )
    order = F.xxhash64(F.lit("mix"), F.col("doc_id"), F.col("size"))
    stream = sizes.withColumn("_h", order).withColumn("_bucket", F.pmod(F.shiftright("_h", 20), F.lit(BUCKETS)))
    stream = stream.withColumn("_words", F.col("size") * F.col("copies"))
    stream = written(running_sum(stream, ["source"], "_bucket", ["_h", "doc_id", "size"], "_words", "_at"), "stream")
    rows = expanded(stream.withColumn("_one", F.lit(1).cast("long")), "_one", "copies", "_copy").withColumn("_from", F.col("_at") + (F.col("_copy") - 1) * F.col("size"))
    pieces = (
        rows.where("size > 0")
        .withColumn("_to", F.col("_from") + F.col("size"))
        .withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / block_words), F.floor((F.col("_to") - 1) / block_words))))
    )
    got = F.when(F.col("_end").isNotNull(), F.greatest(F.least("_to", "_end") - F.greatest("_from", "_start"), F.lit(0)))
    p = pieces.select("source", "doc_id", "size", "_copy", "_from", "_to", "_block")
    t = takes.withColumnRenamed("_block", "_taken_block")
    taken = (
        p.join(t, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_taken_block")), "left")
        .groupBy("source", "doc_id", "size", "_copy")
        .agg(F.sum(F.coalesce(got, F.lit(0))).alias("taken"), F.min(F.when(got > 0, F.col("slot"))).alias("first_slot"))
        .select("source", "doc_id", "size", "taken", "first_slot")
    )
    empty = rows.where("size = 0").select("source", "doc_id", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return taken.unionByName(empty).join(g, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "first_slot"
    )


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot")


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them, all columns as they are.

    A document that the mix cuts counts as whole from half its words on; a source of which words are taken, but of no document half, gives the one that
    most are taken of. Documents without words stay as they are. Rows that are alike in id, source and size are
    numbered on both sides, so that repeated rows meet one another once each.
    """
    cols, keys = docs.columns, ["__doc", "__source", "__size"]
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    taken = written(mix(docs, id_col, text_col, source_col), "taken")
    most = F.max_by(F.struct("doc_id", "size"), F.struct("taken", "size", F.col("doc_id").cast("string")))
    bare = taken.where("taken > 0").groupBy("source").agg(F.max(F.col("taken") / F.col("size")).alias("share"), most.alias("most")).where("share < 0.5")  # a row a source at most
    bare = bare.select(F.col("source").alias("_bare"), F.col("most.doc_id").alias("_id"), F.col("most.size").alias("_size"))
    same = F.col("source").eqNullSafe(F.col("_bare")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size"))
    times = F.when(F.col("size") == 0, 1).when(F.col("_size").isNotNull() & (F.col("taken") > 0), 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    taken = taken.join(bare, same, "left").withColumn("_times", times)
    taken = taken.select(
        F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("_times").alias("__times")
    ).withColumn("__n", number)
    taken = taken.where("__times > 0").select(*[F.col(k).alias(f"{k}2") for k in [*keys, "__n"]], "__times")
    rows = docs.withColumns({"__doc": F.col(id_col), "__source": F.col(source_col).cast("string"), "__size": word_count(F.col(text_col))}).withColumn("__n", number)
    same = [F.col(k).eqNullSafe(F.col(f"{k}2")) for k in [*keys, "__n"]]
    return rows.join(taken, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(*cols)
