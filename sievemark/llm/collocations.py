"""Phrase collocations from count streams in prefix and in suffix order.

Tasks count the phrases of one to three words of their texts and deal them by hash into buckets; a bucket's counts travel as compressed blocks of phrases in order of their words,
so that the one shuffle that grows with the corpus costs a few bytes a phrase. A bucket holds about BUCKET bytes of text whatever the corpus is, and a phrase comes once from each task.
What has fewer than `least` occurrences can't matter further: no part of a candidate is rarer than the candidate.

The counts are then two streams on disk, in ranges: in prefix order a phrase follows the phrases that it begins with, in suffix order those it ends in.
One pass over each stream in order holds the last phrase of one and of two words, so every phrase meets the counts of its beginnings and ends, and every phrase of
two words its most frequent extensions, without a table of phrases to look up. A range starts with what the ranges before it had last, a row of each length for each range.

Defined results: null text is empty, null lang is `und`; words are compared as bytes; repeated rows count each time; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import PART, in_parts, numbered
from .common import documents, text_of, written

LEAST, COVERED, TOP = 10, 50, 2000
"""Occurrences of a candidate; per cent of them within a longer candidate that drop it; rows kept of each language."""
TOKENS = 1_000_000
"""Words that a task counts at once; a longer text is one count."""
BUCKET = 8 << 20
DENSE = 1 << 21
"""Up to so many distinct words, three of them fit 63 bits."""

# What ends a piece, and what parts words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(ENDS)] = 2


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words as binary, and for each word in order its number, its piece, its text) of an array of binary."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.binary() else np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[first:last] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    begins = np.zeros(len(raw) + 1, bool)
    begins[offsets - first] = True  # a text ends words and pieces as well
    start = inside.copy()
    start[1:] &= ~inside[:-1] | begins[1:-1]
    at = np.flatnonzero(start)
    piece = np.cumsum((kind == 2) | begins[:-1], dtype=np.int64)[at]
    chars = np.cumsum(inside, dtype=np.int64)
    ends = np.append(chars[at[1:]] - 1, chars[-1] if len(raw) else 0) if len(at) else np.zeros(0, np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(_LOWER[raw[inside]])])
    coded = words.dictionary_encode()
    text = np.searchsorted(offsets - first, at, side="right") - 1
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), piece, text


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[new], np.diff(np.append(new, len(codes)))


def phrases(words: np.ndarray, piece: np.ndarray, size: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """For one, two and three words: (the numbers of the phrase's first, second, ... word, how often it occurs)."""
    u, n = _distinct(words)
    yield [u], n
    two = piece[1:] == piece[:-1]
    codes = words[:-1] * size + words[1:]
    u, n = _distinct(codes[two])
    yield [u // size, u % size], n
    three = two[1:] & two[:-1]
    if size <= DENSE:
        u, n = _distinct((codes[:-1] * size + words[2:])[three])
        yield [u // size // size, u // size % size, u % size], n
    else:
        known, rank = np.unique(codes, return_inverse=True)
        u, n = _distinct((rank[:-1] * size + words[2:])[three])
        head = known[u // size] if len(known) else u
        yield [head // size, head % size, u % size], n


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _block(phrase: pa.Array, n: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([phrase, pa.array(n.astype(np.int64))], names=["phrase", "n"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _counted(langs: list[str], texts: list[pa.Array], buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of some texts, a block for each language and bucket; langs has the language of each text. The empty phrase counts all words."""
    column = pa.concat_arrays([t.cast(pa.large_binary()) for t in texts])
    names, of_text = np.unique(np.array(langs, dtype=object), return_inverse=True)
    words, number, piece, text = tokens(column)
    lang = of_text[text] if len(text) else np.zeros(0, np.int64)
    order = np.argsort(lang, kind="stable")
    number, piece, lang = number[order], piece[order], lang[order]
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.as_buffer()) for w in words), np.uint64, len(words))
    for k, name in enumerate(names):
        a, b = np.searchsorted(lang, [k, k + 1])
        if a == b:
            continue
        found, count, at = [pa.array([b""], pa.large_binary())], [np.array([b - a])], [np.zeros(1, np.int64)]
        for parts, n in phrases(number[a:b], piece[a:b], len(words)):
            own = [words.take(pa.array(p)) for p in parts]
            found.append(pc.binary_join_element_wise(*own, pa.scalar(b" ", pa.large_binary())) if len(own) > 1 else own[0])
            count.append(n)
            h = np.zeros(len(n), np.uint64)
            for p in parts:
                h = _mix(h + hashes[p])
            at.append((h % np.uint64(buckets)).astype(np.int64))
        found, count, at = pa.concat_arrays(found), np.concatenate(count), np.concatenate(at)
        order = np.argsort(at, kind="stable")
        found, count, ends = found.take(pa.array(order)), count[order], np.searchsorted(at[order], np.arange(buckets + 1))
        full = np.flatnonzero(ends[1:] > ends[:-1])
        for f in range(0, len(full), 64):
            some = full[f : f + 64]
            blocks = [_block(found.slice(ends[i], ends[i + 1] - ends[i]), count[ends[i] : ends[i + 1]]) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(blocks, pa.binary())], names=["lang", "bucket", "block"])


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, texts, size = [], [], 0
        for b in batches:
            column = b.column("text").cast(pa.binary())
            for f in range(0, len(column)):
                own = column.slice(f, 1)
                langs.append(b.column("lang")[f].as_py())
                texts.append(own)
                size += len(own[0].as_buffer()) // 5 + 1
                if size > TOKENS:
                    yield from _counted(langs, texts, buckets)
                    langs, texts, size = [], [], 0
        if texts:
            yield from _counted(langs, texts, buckets)

    return run


def _sums(least: int):
    def run(blocks: pa.Table) -> pa.Table:
        tables = [pa.ipc.open_stream(x.as_buffer()).read_all() for c in blocks.column("block").chunks for x in c]
        f = pa.concat_tables(tables).group_by("phrase").aggregate([("n", "sum")])
        f = f.filter(pc.or_(pc.greater_equal(f["n_sum"], least), pc.equal(f["phrase"], b"")))
        k = pc.if_else(pc.equal(f["phrase"], b""), 0, pc.add(pc.count_substring(f["phrase"], " "), 1)).cast(pa.int32())
        phrase = pa.chunked_array([c.cast(pa.binary()).view(pa.string()) for c in f["phrase"].chunks], pa.string())
        lang = pa.array([blocks.column("lang")[0].as_py()] * len(f), pa.string())
        return pa.table([lang, k, phrase, f["n_sum"]], names=["lang", "k", "phrase", "f"])

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, k, phrase, f) of phrases of k = 1 to 3 words of at least `least` occurrences within pieces; k = 0 has all words of the language."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = rows.mapInArrow(_count(size // BUCKET + 1), "lang string, bucket int, block binary")
    return blocks.groupBy("lang", "bucket").applyInArrow(_sums(least), "lang string, k int, phrase string, f long")


def lockstep(rows: DataFrame, words: list[Column], sub1: str, sub2: str, extension: str, name: str) -> DataFrame:
    """rows (lang, k, phrase, f, ...) with the counts of their first one and two words in the order given (sub1, sub2) and, of phrases of two words, the most
    occurrences of one that goes on by a third (extension). words: the phrase's words in the stream's order."""
    keys = ["lang", "_1", "_2", "_3"]  # a missing word comes first, so a phrase stands right before those that go on from it
    stream = in_parts(rows.withColumns({f"_{i + 1}": w for i, w in enumerate(words)}), keys, name)
    last = lambda k: F.max(F.when(F.col("k") == k, F.struct(*keys, "k", "f"))).alias(f"last{k}")
    heads = stream.where("k < 3").groupBy(PART).agg(last(1), last(2))
    all_parts = stream.select(PART).distinct().join(heads, PART, "left")
    up = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    held = all_parts.select(PART, *[F.last(f"last{k}", ignorenulls=True).over(up).alias(f"last{k}") for k in (1, 2)])
    held = held.select(PART, F.explode(F.array("last1", "last2")).alias("h")).where("h is not null").select(PART, "h.*")
    both = stream.withColumn("_own", F.lit(True)).unionByName(held.withColumn("_own", F.lit(False)), allowMissingColumns=True).repartitionByRange(PART)
    seen = Window.partitionBy(PART).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    of = lambda k: F.last(F.when(F.col("k") == k, F.col("f")), ignorenulls=True).over(seen)
    longer = F.max(F.when(F.col("k") == 3, F.col("f"))).over(Window.partitionBy(PART, *keys[:3]))
    both = both.withColumns({sub1: F.when(F.col("k") > 1, of(1)), sub2: F.when(F.col("k") > 2, of(2)), extension: F.when(F.col("k") == 2, longer)})
    # Extensions that lie in later parts than their phrase: they met the copy that its part handed on, at most one for each part.
    more = both.where(~F.col("_own") & F.col(extension).isNotNull()).groupBy(*keys[:3]).agg(F.max(extension).alias("_more"))
    out = both.where("_own").join(F.broadcast(more), keys[:3], "left")
    more = F.when(F.col("k") == 2, F.greatest(extension, "_more"))
    return out.withColumn(extension, more).drop("_more", "_own", PART, *keys[1:])


def scored(counts: DataFrame, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of candidates, but for those that lie within a longer one to `covered` per cent."""
    w = F.split("phrase", " ")
    rows = lockstep(counts.where("k > 0"), [F.get(w, i) for i in range(3)], "first1", "first2", "right", "prefix-stream")
    rows = lockstep(rows, [F.get(w, F.col("k") - 1 - i) for i in range(3)], "last1", "last2", "left", "suffix-stream")
    cut = lambda l, r: F.struct(F.expr(f"cast(1000000 as decimal(7,0)) * cast(f as decimal(16,0)) * cast(f as decimal(15,0)) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))").alias("score"), F.col(l).alias("l"), F.col(r).alias("r"))
    one, two = cut("first1", "last1"), F.when(cut("first1", "last2")["score"] <= cut("first2", "last1")["score"], cut("first1", "last2")).otherwise(cut("first2", "last1"))
    kept = F.coalesce(100 * F.greatest("left", "right") < covered * F.col("f"), F.lit(True))
    rows = rows.where(F.col("k") > 1).where(kept).withColumn("c", F.when(F.col("k") == 2, one).otherwise(two))
    return rows.select("lang", "phrase", F.col("f").alias("a"), "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language by score."""
    counts = written(phrase_counts(docs, least), "phrase-counts")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # A language may hold most rows, so ranks come from parts of the order.
    ranked = numbered(in_parts(scored(counts, covered), ["lang", *order], "scored"), ["lang"], order, "rank", 1).where(F.col("rank") <= top)
    total = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = {
    "op12_collocations": f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, row_number() OVER () AS p, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda s: s <> '') AS ws FROM p),
    t AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM (SELECT lang, p, unnest(ws) AS w1, unnest(range(len(ws))) AS i FROM w) WINDOW o AS (PARTITION BY p ORDER BY i)),
    g AS (SELECT lang, k, array_to_string(x, ' ') AS phrase, x, count(*) AS f FROM (SELECT lang, 1 AS k, [w1] AS x FROM t UNION ALL SELECT lang, 2, [w1, w2] FROM t WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, [w1, w2, w3] FROM t WHERE w3 IS NOT NULL) GROUP BY ALL),
    c AS (SELECT * FROM g WHERE k > 1 AND f >= 10),
    cuts AS (SELECT lang, phrase, x, k, f AS a, cut FROM c, (VALUES (1), (2)) v(cut) WHERE cut < k),
    s AS (SELECT cuts.*, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f::HUGEINT))::BIGINT AS score FROM cuts
        JOIN g l ON l.lang = cuts.lang AND l.phrase = array_to_string(cuts.x[1 : cut], ' ') JOIN g r ON r.lang = cuts.lang AND r.phrase = array_to_string(cuts.x[cut + 1 : cuts.k], ' ')),
    best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, array_to_string(x[1 : 2], ' ') AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, f, array_to_string(x[2 : 3], ' ') FROM c WHERE k = 3) GROUP BY ALL),
    n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang)
    SELECT best.lang, row_number() OVER o AS rank, best.phrase, a, l, r, n, score FROM best JOIN n ON n.lang = best.lang LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase
    WHERE longer.f IS NULL OR 100 * longer.f < 50 * a WINDOW o AS (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) QUALIFY row_number() OVER o <= 2000"""
}
