"""Document fingerprints by SpotSigs.

A signature is a common word (anchor) with the next CHAIN content words; a text's fingerprint is the set of its signatures, as
sorted 32-bit hashes in hex. Likeness is the Jaccard similarity of two sets. near_pairs() partitions texts by set length, so
that only neighbouring partitions can be alike, and joins on each set's rarest signatures only.

Defined results: null text counts as empty; a text without anchors takes every content word as the start of a chain, one too
short for that is a single signature of its words, an empty text has the signature of no words; so equal texts have equal fingerprints and
no set is empty. Next documents go by descending doc_id, then descending text, null ids last; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, text_of, written

# Common words of the languages in use.
ANCHORS = frozenset(
    "the of and to in a is that it for on was be as are with at by this from or an not have "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es "
    "le la les de des et un une du en que qui est pour dans sur pas au par ce "
    "el los las y del se por con una su para al lo como mas o".split()
)
CHAIN = 2
KNOWN_CHARS = 1_500_000
"""Characters of the words that a worker remembers; it changes speed only."""
THRESHOLD = 0.8
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


class Spots:
    """Signature sets of texts. Remembers word hashes; that changes speed only."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.chars = 0

    def _code(self, token: str) -> int:
        """0 for a token without letters or digits; else its hash, odd for anchors, even for content words."""
        word = _EDGE.sub("", token)
        return xxhash.xxh64_intdigest(word) & ~1 | (word in ANCHORS) or 2 if word else 0

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct 32-bit signatures."""
        tokens, known = text.lower().split(), self.known
        if self.chars > KNOWN_CHARS:
            known.clear()
            self.chars = 0
        for t in {*tokens}:
            if t not in known:
                known[t] = self._code(t)
                self.chars += len(t)
        code = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        code = code[code != 0]
        anchor = (code & np.uint64(1)).astype(bool)
        content = code[~anchor]
        start = np.cumsum(~anchor)[anchor]  # the content word that follows each anchor
        keep = start <= len(content) - CHAIN
        start, h = start[keep], code[anchor][keep].copy()
        if not len(start):
            start = np.arange(max(0, len(content) - CHAIN + 1))
            h = np.zeros(len(start), np.uint64)
        if not len(start):
            return np.array([xxhash.xxh32_intdigest(code.tobytes())], np.uint32)
        for i in range(CHAIN):
            h = (h ^ content[start + i]) * (_A if i % 2 else _B)
            h ^= h >> np.uint64(29)
        return np.unique((h * _A >> np.uint64(32)).astype(np.uint32))


def hex_of(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 without a look at them where their lengths rule `least` out."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SMALL_PART, LARGE_PART = 4 << 20, 256 << 20
"""Bytes of a range of ids: small ones as long as there are PARTS of them at most, beyond that larger ones, and then as many as it takes."""
PARTS = 2048


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, tail, doc_id, text): ranges of ids, sorted by descending id within each, and after each the first row of the next one (tail).

    Texts are shuffled once; only the ranges' first rows go to two places. Null ids come last, in ranges of the first bytes of their texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    begin = F.coalesce(F.conv(F.hex(F.substring(F.col("text").cast("binary"), 1, 6)), 16, 10).cast("double"), F.lit(0.0)) * F.pow(F.lit(256.0), 6 - F.least(F.octet_length("text"), F.lit(6)))
    rows = rows.withColumn("begin", F.when(F.col("doc_id").isNull(), begin))
    size = F.octet_length("text").cast("long")
    total, nulls = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), size)), F.lit(0))).first()

    def edges(column: str, size: int) -> np.ndarray:
        parts = max(min(PARTS, size // SMALL_PART), size // LARGE_PART) + 1
        return np.array(sorted(set(rows.approxQuantile(column, [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else [], float)

    edge, null_edge = edges("doc_id", total), edges("begin", nulls)
    parts = len(edge) + 1 + (len(null_edge) + 1 if nulls else 0)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, begin: pd.Series) -> pd.Series:
        # In ascending order of part, rows come in ascending order; null ids have the parts below 0.
        null = np.searchsorted(null_edge, begin.fillna(0).astype(float), side="right") - len(null_edge) - 1
        return pd.Series(np.where(ids.isna(), null, np.searchsorted(edge, ids.fillna(0).astype(float), side="right")))

    rows = rows.withColumn("part", part_of("doc_id", "begin")).drop("begin")
    heads = rows.groupBy("part").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "text")).alias("h"))
    heads = written(heads, "heads")
    by = Window.orderBy("part")  # over one row for each range
    to = F.coalesce(F.lead("part").over(by), F.first("part").over(by))
    tails = heads.select(to.alias("part"), F.lit(1).alias("tail"), F.col("h.doc_id").alias("doc_id"), F.col("h.text").alias("text"))
    every = rows.select("part", F.lit(0).alias("tail"), "doc_id", "text").unionByName(tails)
    return every.repartition(parts, "part").sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), F.desc("text"))


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spots, last = Spots(), None  # (part, doc_id, text, its signatures)
    out: list[tuple] = []
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    send = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
    for batch in batches:
        for part, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            text = text.as_py()
            own = spots(text)
            if last and last[0] == part:
                _, i, t, signatures = last
                e = edited(t, text)
                es = spots(e)
                out.append((i, len(t), e, hex_of(signatures), hex_of(es), likeness(signatures, es), likeness(signatures, own)))
                if len(out) >= 128:
                    yield send()
                    out = []
            last = (part, doc_id, text, own)
    if out:
        yield send()


def compare_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next."""
    return in_order(docs, id_col, text_col).mapInArrow(
        _paired, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spots = Spots()
    for batch in batches:
        sets = [spots(t.as_py()).astype(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "spots"])


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): (doc_id, rep, f) of every document, f naming its fingerprint and rep being the smallest id of those that have it; and (a, b, fa, fb, likeness) of
    all pairs of reps at least `threshold` alike.

    A set of n signatures shares one of its n - ceil(threshold * n) + 1 rarest with every set that alike. Sets lie in partitions of
    lengths threshold^-p to threshold^-(p+1), and meet in their own partition or the next.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    signed = written(rows.mapInArrow(_signed, "doc_id long, spots array<long>"), "spots")
    named = signed.withColumn("f", F.sha2(F.array_join("spots", ","), 256))
    reps = written(named.groupBy("f").agg(F.min("doc_id").alias("rep"), F.first("spots").alias("spots")), "reps")
    each = reps.select("f", F.size("spots").alias("n"), F.explode("spots").alias("s"))
    df = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")  # others can't be shared
    rarest = each.join(df, "s").withColumn("k", F.row_number().over(Window.partitionBy("f").orderBy("df", "s")))
    # Signatures without a partner are the rarest of all: they use up places.
    alone = each.join(df, "s", "left_anti").groupBy("f").agg(F.count(F.lit(1)).alias("alone"))
    prefix = rarest.join(alone, "f", "left").where(F.col("k") + F.coalesce("alone", F.lit(0)) <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    part = F.floor(F.log("n") / -math.log(threshold)).cast("int")
    prefix = written(prefix.select("f", "n", "s", part.alias("p")), "prefixes")
    left = prefix.select(F.col("f").alias("fa"), F.col("n").alias("na"), "s", F.explode(F.array("p", F.col("p") + 1)).alias("p"))
    right = prefix.select(F.col("f").alias("fb"), F.col("n").alias("nb"), "s", "p")
    met = left.join(right, ["s", "p"]).where((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("fa") < F.col("fb")))).where(F.col("na") >= F.col("nb") * threshold)
    met = met.select("fa", "fb").distinct()
    x = reps.select(F.col("f").alias("fa"), F.col("rep").alias("a"), F.col("spots").alias("x"))
    y = reps.select(F.col("f").alias("fb"), F.col("rep").alias("b"), F.col("spots").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    links = met.join(x, "fa").join(y, "fb").select("a", "b", "fa", "fb", (shared / (F.size("x") + F.size("y") - shared)).alias("likeness")).where(F.col("likeness") >= threshold)
    return named.join(reps.select("f", "rep"), "f").select("doc_id", "rep", "f"), links


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_next(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
