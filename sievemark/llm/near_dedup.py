"""MinHash near-dedup by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

A text's features are its distinct shingles of five words, weighed by count times idf. idf falls from 2 for a shingle of at most one in 2^RARE_BITS documents
to 1 for one of every document, with the logarithm of the share, in steps of 1/8. So it depends on shares of the corpus alone, not on its size, and only frequent shingles
must be known: a count-mean-min sketch of DEPTH * 2^WIDTH_BITS cells, filled over all documents, tells them, the better the more documents there are. ICWS draws SAMPLES
features, each with a chance in proportion to its weight, so that two texts agree in a sample as often as their weighted Jaccard similarity says. Samples are banded; texts
that share a band are candidates, and two texts are linked only if their weighted Jaccard similarity, over whole texts, is the threshold or more.

Every pair of a bucket is decided, but no pair is a row. Buckets of the same texts count once. A bucket's texts, as features, meet in blocks of bounded
size; a block finds all its similarities by matrix products and returns one link for each text that has any. Only a bucket of more than one block goes on: its texts outside
its largest class are compared with all of its texts, again in blocks. Rows grow with the texts of a bucket times the blocks that its smaller classes fill.

Defined results: null text counts as empty; equal texts, empty ones too, are of one class; a text of fewer words is one shingle; null ids come after all
others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, text_of, written
from .components import components
from .shingles import Shingler

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 18, 4
SAMPLES = BANDS * ROWS
DEPTH, WIDTH_BITS = 3, 16
STEPS, RARE_BITS = 8, 10
BLOCK_FEATURES, BLOCK_TEXTS = 1 << 18, 1 << 10
"""Features and texts that a block of candidates holds, about."""
FEW = 32
"""Texts of a block that share a feature, up to which its pairs are counted one by one; it changes speed only."""
TABLE_BITS = 16
KEPT = 96
"""Weights whose tables a worker keeps; it changes speed only."""

_U = np.uint64
_ODD = np.random.default_rng(20_240_501).integers(0, 1 << 63, (DEPTH + SAMPLES + BANDS, 2), np.uint64) | _U(1)


def _cells(features: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((features * _ODD[row, 0] + _ODD[row, 1]) >> _U(64 - bits)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, n) of all documents of a task; the cell after the last counts documents."""
    shingles, counts, n = Shingler(SHINGLE), np.zeros((DEPTH, 1 << WIDTH_BITS), np.int64), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            found = [shingles(t.as_py())[0] for t in batch.column(0).slice(at, 128)]
            n += len(found)
            found = np.concatenate(found)
            for d in range(DEPTH):
                counts[d] += np.bincount(_cells(found, d, WIDTH_BITS), minlength=1 << WIDTH_BITS)
    flat = np.r_[counts.ravel(), n]
    some = np.flatnonzero(flat)
    for at in range(0, len(some), 10_000):
        own = some[at : at + 10_000]
        yield pa.RecordBatch.from_pydict({"cell": pa.array(own, pa.int32()), "n": pa.array(flat[own], pa.int64())})


class Idf:
    """Steps of 1/STEPS, from STEPS to 2 * STEPS, for features."""

    def __init__(self, counts: np.ndarray, n: int):
        self.counts = counts
        self.noise = counts.sum(1) / counts.shape[1]
        # idf = 1 + log2(n / df) / RARE_BITS, 2 at most, rounded to steps: df at which it falls by one step.
        self.cuts = n * 2.0 ** (RARE_BITS * ((np.arange(STEPS) + 0.5) / STEPS - 1))

    def __call__(self, features: np.ndarray) -> np.ndarray:
        # What a cell holds beyond the mean cell is the feature's own frequency; the median over rows is taken.
        a, b, c = (self.counts[d][_cells(features, d, WIDTH_BITS)] - self.noise[d] for d in range(DEPTH))
        df = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
        return 2 * STEPS - np.searchsorted(self.cuts, df)


def corpus_idf(docs: DataFrame, text_col: str = "text") -> Idf:
    """The sketch that comes to the driver has DEPTH * 2^WIDTH_BITS + 1 numbers, however large the corpus."""
    rows = docs.select(text_of(text_col).alias("text")).mapInArrow(_sketch, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    flat = np.zeros(DEPTH * (1 << WIDTH_BITS) + 1, np.int64)
    got = rows.toArrow()
    flat[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return Idf(flat[:-1].reshape(DEPTH, -1), int(flat[-1]))


class Sampler:
    """ICWS. The variates of a feature come from a table of 2^TABLE_BITS rows, by another hash for each sample; so the value to be minimised
    depends only on the table row and the weight, and is kept for each weight that occurs. One 64-bit hash gives the rows of four samples."""

    def __init__(self):
        rng, n = np.random.default_rng(7), 1 << TABLE_BITS
        self.r, self.log_c, self.beta = rng.gamma(2, 1, n), np.log(rng.gamma(2, 1, n)), rng.random(n)
        self.forget()

    def forget(self) -> None:
        n = 1 << TABLE_BITS
        self.place = np.full(1 << 12, -1, np.int32)  # of each weight up to 4095 in the kept tables
        self.values, self.steps, self.used = np.empty((KEPT, n), np.float32), np.empty((KEPT, n), np.int32), 0

    def levels(self, weights: np.ndarray) -> np.ndarray:
        """Place of each weight (in steps of 1/STEPS, up to 4095) in the kept tables."""
        at = self.place[weights]
        if (at < 0).any():
            new = np.unique(weights[at < 0])
            if self.used + len(new) > KEPT:
                self.forget()
                new = np.unique(weights)
            self.place[new] = self.used + np.arange(len(new))
            self.add(new)
            at = self.place[weights]
        return at

    def add(self, weights: np.ndarray) -> None:
        t = np.floor(np.log(weights[:, None] / STEPS) / self.r + self.beta)
        a = self.log_c - self.r * (t - self.beta) - self.r
        if self.used + len(weights) > len(self.values):  # a text of very many different weights
            self.values, self.steps = np.resize(self.values, (self.used + len(weights), len(self.r))), np.resize(self.steps, (self.used + len(weights), len(self.r)))
        self.values[self.used : self.used + len(weights)], self.steps[self.used : self.used + len(weights)] = a, t
        self.used += len(weights)

    def bands(self, features: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """BANDS hashes, each of ROWS samples (feature, step)."""
        best, out = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint64)
        odd, every = _ODD[DEPTH : DEPTH + SAMPLES // 4], np.arange(SAMPLES)
        big = weights >= 1 << 12  # shingles repeated hundreds of times: too many weights for tables
        parts = [(features, weights, False)] if not big.any() else [(features[~big], weights[~big], False), (features[big], weights[big], True)]
        for features, weights, direct in parts:
            level = None if direct else self.levels(weights) << TABLE_BITS
            for at in range(0, len(features), 2048):
                f = features[at : at + 2048]
                x = f[None] * odd[:, :1] + odd[:, 1:]
                x ^= x >> _U(32)
                x *= _U(0xD6E8FEB86659FD93)
                x ^= x >> _U(29)
                cell = x.view(np.uint16).reshape(len(odd), len(f), 4).transpose(0, 2, 1).reshape(SAMPLES, len(f))
                if direct:
                    r, beta = self.r[cell], self.beta[cell]
                    t = np.floor(np.log(weights[at : at + 2048] / STEPS) / r + beta)
                    value = (self.log_c[cell] - r * (t - beta) - r).astype(np.float32)
                    k = value.argmin(1)
                    step = t[every, k].astype(np.int64).astype(np.uint64)
                else:
                    cell = cell + level[at : at + 2048]
                    value = self.values.ravel().take(cell)
                    k = value.argmin(1)
                    step = self.steps.ravel()[cell[every, k]].astype(np.int64).astype(np.uint64)
                low = value[every, k]
                sample = (f[k] + step * _U(0x9E3779B97F4A7C15)) * _U(0xD6E8FEB86659FD93)
                out = np.where(low < best, sample, out)
                best = np.minimum(low, best)
        x = out.reshape(BANDS, ROWS)
        h = _ODD[DEPTH + SAMPLES :, 0].copy()
        for i in range(ROWS):
            h = (h ^ x[:, i]) * _U(0xBF58476D1CE4E5B9)
            h ^= h >> _U(31)
        return h


def _banded(idf: Idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sampler, known = Shingler(SHINGLE), Sampler(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for digest, text in zip(part.column(1).to_pylist(), part.column(2)):
                    if digest not in known:
                        if len(known) > 4096:
                            known.clear()
                        f, n = shingles(text.as_py())
                        known[digest] = (len(f), sampler.bands(f, n * idf(f)).view(np.int64) if len(f) else [])
                    out.append(known[digest])
                sizes, bands = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "digest", "size", "bands"])

    return run


def _featured(idf: Idf):
    """From (key, text) to (key, features, weights), sorted by feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(SHINGLE)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, features, weights = batch.slice(at, 256), [], []
                for text in part.column(1):
                    f, n = shingles(text.as_py())
                    features.append(f.tobytes())
                    weights.append((n * idf(f)).astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(features, pa.binary()), pa.array(weights, pa.binary())], ["key", "features", "weights"])

    return run


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sets of (sorted features, weights); 1 if both are empty."""
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low)) if len(a[0]) or len(b[0]) else 1.0


def similarities(texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarity of all pairs of (features, weights). Of two texts that hold a feature, the smaller weight is shared.

    Pairs that share a feature of few texts are added up one by one. A feature of many is cut into layers of weight, each of which a text
    holds or not, so that what is shared is a sum of products."""
    m = len(texts)
    f, w, t = np.concatenate([x[0] for x in texts]), np.concatenate([x[1] for x in texts]).astype(np.int64), np.repeat(np.arange(m), [len(x[0]) for x in texts])
    total = np.bincount(t, w, m)
    by = np.lexsort((w, f))
    f, w, t = f[by], w[by], t[by]
    new = np.r_[True, f[1:] != f[:-1]]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(f)])
    end, of = np.repeat(first + size, size), np.repeat(size, size)
    place, layer = np.arange(len(f)), np.where(new, w, w - np.r_[0, w[:-1]])
    pairs, values = [np.zeros(0, np.int64)], [np.zeros(0)]
    at = place[(of > 1) & (of <= FEW)]
    for k in range(1, FEW):
        at = at[at + k < end[at]]
        if not len(at):
            break
        pairs.append(t[at] * m + t[at + k])
        values.append(w[at])
    shared = np.bincount(np.concatenate(pairs), np.concatenate(values), m * m).astype(float).reshape(m, m)
    many = place[(of > FEW) & (layer > 0)]
    for k in range(0, len(many), 1024):
        own = many[k : k + 1024]
        n = end[own] - own
        row = np.repeat(np.arange(len(own)), n)
        x = np.zeros((len(own), m), np.float32)
        x[row, t[own[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]] = 1
        shared += np.triu((x * layer[own, None].astype(np.float32)).T @ x, 1)
    shared = shared + shared.T
    np.fill_diagonal(shared, total)
    return shared / np.maximum(total[:, None] + total[None] - shared, 1e-9)


def _links(threshold: float):
    """From blocks (band, i, j, key, small, features, weights), in order, to links (a, b): of each class of a block's texts, one for every text but the smallest.
    Where some texts are small, pairs without one of them don't count."""

    def block(keys: np.ndarray, small: np.ndarray, texts: list) -> tuple[np.ndarray, np.ndarray]:
        own, low = np.unique(keys, return_index=True)
        flag = np.zeros(len(own), bool)
        np.logical_or.at(flag, np.searchsorted(own, keys), small)
        near = similarities([texts[i] for i in low]) >= threshold if len(own) > 2 else np.full((len(own), len(own)), len(own) == 2 and weighted_jaccard(texts[low[0]], texts[low[1]]) >= threshold)
        if flag.any():
            near &= flag[:, None] | flag[None]
        label = np.arange(len(own))
        while True:
            new = np.minimum(label, np.where(near, label[None], len(own)).min(1, initial=len(own)))
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = label != np.arange(len(own))
        return own[some], own[label[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = ([], [], []), None
        out_a, out_b = [], []

        def settle() -> None:
            if len(held[0]) > 1:
                a, b = block(np.array(held[0], np.int64), np.array(held[1], bool), held[2])
                out_a.append(a)
                out_b.append(b)
            for x in held:
                x.clear()

        for batch in batches:
            band, i, j, key, small = (batch.column(c).to_pylist() for c in range(5))
            for at, name in enumerate(zip(band, i, j)):
                if name != now:
                    settle()
                    now = name
                held[0].append(key[at])
                held[1].append(small[at])
                held[2].append(tuple(np.frombuffer(batch.column(c)[at].as_py(), t) for c, t in ((5, np.uint64), (6, np.uint32))))
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_a, out_b)], ["a", "b"])
                out_a, out_b = [], []
        settle()
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_a, out_b)], ["a", "b"])

    return run


def _blocks(texts: Column, size: Column, share: int = 1) -> Column:
    """Into how many blocks so many texts and features go."""
    return F.greatest(F.lit(1), F.ceil(texts * share / BLOCK_TEXTS), F.ceil(size * share / BLOCK_FEATURES)).cast("long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size, kept; the class is named by its smallest id, whose first row is kept. digest: SHA-256 of the text."""
    idf = corpus_idf(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text_of(text_col), 256)).alias("digest"), text_of(text_col).alias("text"))
    signed = rows.mapInArrow(_banded(idf), "doc_id long, digest binary, size long, bands array<long>").withColumn("row", F.monotonically_increasing_id())
    signed = written(signed, "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    texts = signed.groupBy("digest").agg(first.alias("f"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    texts = written(texts.select("digest", F.col("f.doc_id").alias("doc_id"), F.col("f.row").alias("key"), "copies", "size", "bands"), "texts")
    spread = texts.select("key", "size", F.explode("bands").alias("band"))
    # Buckets of the same texts (by number, size and two hashes of the set) count once.
    same = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
    buckets = spread.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("features"), *same).where("n > 1")
    buckets = buckets.groupBy("n", "features", "x0", "x1").agg(F.min("band").alias("band")).select("band", "n", "features")
    members = written(spread.join(buckets, "band"), "members")
    wanted = members.select("key").distinct().join(texts.select("key", "doc_id", "digest"), "key")
    # Only texts with a candidate are read again; one row for each.
    again = rows.join(wanted.withColumnRenamed("doc_id", "own"), "digest").where(F.col("doc_id").eqNullSafe(F.col("own"))).select("key", "text").dropDuplicates(["key"])
    whole = written(again.mapInArrow(_featured(idf), "key long, features binary, weights binary"), "features")

    def linked(blocks: DataFrame) -> DataFrame:
        dealt = blocks.join(whole, "key").select("band", "i", "j", "key", "small", "features", "weights").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
        return written(dealt.mapInArrow(_links(threshold), "a long, b long"), "links")

    place = lambda salt, of: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(of)).alias(salt)
    links = linked(members.withColumn("of", _blocks(F.col("n"), F.col("features"))).select("band", "key", place("i", "of"), F.lit(0).alias("j"), F.lit(False).alias("small")))
    classes = components(links)
    wide = members.where(_blocks(F.col("n"), F.col("features")) > 1)
    if wide.limit(1).count():
        named = written(wide.join(classes, "key", "left").withColumn("component", F.coalesce("component", "key")), "wide")
        parts = named.groupBy("band", "component").agg(F.count(F.lit(1)).alias("texts"), F.sum("size").alias("part"))
        parts = parts.groupBy("band").agg(F.max(F.struct("texts", "component")).alias("top"), F.sum("texts").alias("n"), F.sum("part").alias("features"), F.max_by("part", F.struct("texts", "component")).alias("most"))
        # Blocks of half the size, as two of them meet.
        parts = parts.where(F.col("top.texts") < F.col("n")).select(
            "band", F.col("top.component").alias("largest"), _blocks(F.col("n"), F.col("features"), 2).alias("all_of"), _blocks(F.col("n") - F.col("top.texts"), F.col("features") - F.col("most"), 2).alias("small_of")
        )
        named = named.select("band", "key", "component").join(parts, "band")
        every = named.select("band", "key", F.explode(F.sequence(F.lit(0), F.col("small_of") - 1)).alias("i"), place("j", "all_of"), F.lit(False).alias("small"))
        small = named.where("component <> largest").select("band", "key", place("i", "small_of"), F.explode(F.sequence(F.lit(0), F.col("all_of") - 1)).alias("j"), F.lit(True).alias("small"))
        classes = components(links.unionByName(linked(every.unionByName(small))))
    named = texts.select("digest", "doc_id", "key", "copies").join(classes, "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = written(named, "named")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("key").alias("row")))
    per = named.groupBy("component").agg(low.alias("f"), F.sum("copies").alias("class_size"))
    per = per.select("component", F.col("f.doc_id").alias("class_id"), F.col("f.row").alias("keep"), "class_size")
    return (
        signed.select("doc_id", "digest", "row")
        .join(named.select("digest", "component").join(per, "component"), "digest")
        .select("doc_id", "class_id", "class_size", (F.col("row") == F.col("keep")).alias("kept"), "digest")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, one for each class: that of the smallest id."""
    cols, digest = docs.columns, "__digest"
    keep = near_groups(docs, id_col, text_col, threshold).where("kept").select(F.col("digest").alias(digest))
    rows = docs.withColumn(digest, F.unhex(F.sha2(text_of(text_col), 256))).join(keep, digest, "left_semi")
    order = Window.partitionBy(digest).orderBy(F.col(id_col).asc_nulls_last())
    return rows.withColumn("__place", F.row_number().over(order)).where("__place = 1").select(*cols)


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")
