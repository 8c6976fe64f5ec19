"""Hard negatives by anchor-clustered shared lists: exact, with an angular bound that certifies when a walk may end.

Anchors are clustered. For a cluster with centre c whose members are within the angle w of it, no member a can have a larger
inner product with a row v than |a| |v| cos(max(0, angle(v, c) - w)). A cluster sorts the rows by this bound (without |a|) once, and
each member walks the shared list until the bound, times its own length, is under all that it still needs.

Rows are dealt into blocks of about BLOCK by the cell of their nearest centre, so that a list begins with what is near; a cell of any
size, one vector repeated a million times too, is cut into as many blocks as it fills. Anchors are in blocks of ANCHORS. Each
pair of blocks is walked in one task, and what it finds is cut to the ranks asked for before it is merged by anchor. The first walk finds the
positives; their scores then bound the second, which finds the negatives.

Only the clustering is fitted on a sample, of at most SAMPLE anchors; it changes the length of walks, not results.

Defined results: rows with a null label, a null vector or a component that is null or not finite take no part. Shorter vectors count
as filled with zeros. An anchor is told from other rows by its row, not its id, so rows that repeat an id are rows of their own; a null id comes after all ids and is no anchor.
Scores are exact whatever their size, but are ordered and returned within 64 bits, at whose ends they are held. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

BLOCK, ANCHORS = 8192, 8192
CLUSTERS, SAMPLE, ROUNDS = 16, 4096, 8
STEP = 512
"""Rows of a list that are scored at once."""
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100
"""Per cent of the positive's score between which a negative lies."""
EXACT = 2.0**53
LONG = 2**63 - 1
BIG = np.finfo(float).max
MARGIN = 1e-6
"""Added to a cosine that bounds others. An arc cosine near 1 is off by 2e-8 at most."""


def usable(df: DataFrame) -> DataFrame:
    """(row, id, label, v) of rows that take part, with v as doubles. Written, so that a row keeps its number."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.coalesce(~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    rows = df.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), x.alias("v")).where(F.col("label").isNotNull() & F.col("v").isNotNull() & fine)
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _matrix(column: pa.ChunkedArray, scale: float, width: int = 0) -> np.ndarray:
    """Rows of a list column as floor(scale x), short ones filled with zeros."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(a.offsets.to_numpy()) if len(a) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(a.flatten().to_numpy(zero_copy_only=False) * scale), -BIG, BIG)
    width = max(width, int(n.max(initial=0)))
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    out[np.arange(width)[None, :] < n[:, None]] = flat
    return out


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(directions, lengths); of a zero vector both are zero. Scaled first, so that no square overflows."""
    most = np.abs(m).max(axis=1, initial=0)
    s = m / np.where(most > 0, most, 1)[:, None]
    n = np.sqrt((s * s).sum(axis=1))
    return s / np.where(n > 0, n, 1)[:, None], most * n


def centres(rows: np.ndarray, k: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means of the rows' directions, started at rows far from each other."""
    u, n = _unit(rows)
    u = np.unique(u[n > 0], axis=0)
    if not len(u):
        return np.zeros((1, rows.shape[1]))
    c, near = u[:1], u @ u[0]
    while len(c) < min(k, len(u)):
        c = np.vstack([c, u[near.argmin()]])
        near = np.maximum(near, u @ c[-1])
    for _ in range(rounds):
        at = (u @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, u)
        d, n = _unit(sums)
        c = np.where((n > 0)[:, None], d, c)
    return c


def _cells(c: np.ndarray, scale: float):
    def run(batches):
        for b in batches:
            m = _matrix(b.column("v"), scale, c.shape[1])
            cell = (_unit(m)[0][:, : c.shape[1]] @ c.T).argmax(axis=1) if b.num_rows else np.zeros(0, np.int64)
            yield b.append_column("cell", pa.array(cell, pa.int32()))

    return run


def dealt(rows: DataFrame, size: int, out: str) -> tuple[DataFrame, int]:
    """(rows with `out`, how many blocks): blocks of about `size` rows along the cells; rows of a cell are dealt by hash, so no task needs a whole cell."""
    per = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    per = per.withColumn("_from", F.coalesce(F.sum("_n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # CLUSTERS rows
    total = per.agg(F.sum("_n")).first()[0] or 0
    blocks = -(-total // size)
    u = (F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / float(1 << 30)) * F.col("_n") + F.col("_from")
    block = F.least(F.floor(u * blocks / max(total, 1)), F.lit(blocks - 1)).cast("int")
    return rows.join(F.broadcast(per), "cell").withColumn(out, block).drop("_n", "_from"), blocks


def _scores(rows: np.ndarray, members: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products, rows by members; in whole numbers of Python where doubles could round."""
    if most < EXACT:
        return rows @ members.T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    return whole(rows).dot(whole(members).T)


def _held(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array([max(-LONG, min(LONG, x)) for x in scores.ravel()], dtype=np.int64).reshape(scores.shape)
    return scores.astype(np.int64)


def _lists(members: np.ndarray, cluster: np.ndarray, rows: np.ndarray):
    """For each cluster: (its members' places, their lengths, the rows in order of the bound, the bound)."""
    ud, ul = _unit(members)
    vd, vl = _unit(rows)
    for k in np.unique(cluster):
        at = np.flatnonzero(cluster == k)
        c = _unit(ud[at].sum(axis=0)[None, :])[0][0]
        spread = np.arccos(np.clip(ud[at] @ c, -1, 1)).max(initial=0)
        if not c.any():
            spread = np.pi
        angle = np.arccos(np.clip(vd @ c, -1, 1))
        bound = vl * (np.cos(np.maximum(0, angle - spread)) + MARGIN)
        order = np.argsort(-bound, kind="stable")
        yield at, ul[at], order, bound[order]


def _sides(left: pa.Table, right: pa.Table, scale: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Rows and members as matrices of one width, and a bound of the size of their inner products."""
    width = max(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (left, right))
    rows, members = _matrix(left.column("v"), scale, width), _matrix(right.column("v"), scale, width)
    most = float(_unit(rows)[1].max(initial=0)) * float(_unit(members)[1].max(initial=0)) * 1.000001
    return rows, members, most


def _ids(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().fill_null(LONG).to_numpy(zero_copy_only=False)


def _top(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """Places of the k first by score descending, id, row."""
    if len(scores) > 8 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((rows[some], ids[some], -scores[some]))[:k]]
    return np.lexsort((rows, ids, -scores))[:k]


def _positives(scale: float, k: int) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            rows, members, most = _sides(left, right, scale)
            vid, vrow, vlab = _ids(left, "id"), _ids(left, "row"), _ids(left, "label")
            aid, arow, alab = _ids(right, "id"), _ids(right, "row"), _ids(right, "label")
            for at, lengths, order, bound in _lists(members, right.column("cell").to_numpy(), rows):
                best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in at]
                live = np.arange(len(at))
                for f in range(0, len(order), STEP):
                    # A member is done when k of its rows beat the bound of all that follow; a tie could still win by its id.
                    done = [len(best[m][1]) == k and best[m][1][-1] > lengths[m] * bound[f] for m in live]
                    live = live[~np.array(done, dtype=bool)]
                    if not len(live):
                        break
                    part = order[f : f + STEP]
                    s = _held(_scores(rows[part], members[at[live]], most))
                    for j, m in enumerate(live):
                        same = np.flatnonzero((vlab[part] == alab[at[m]]) & (vrow[part] != arow[at[m]]))
                        if len(same):
                            p, x = np.concatenate([best[m][0], part[same]]), np.concatenate([best[m][1], s[same, j]])
                            t = _top(x, vid[p], vrow[p], k)
                            best[m] = (p[t], x[t])
                for m, (p, x) in enumerate(best):
                    out += [(int(arow[at[m]]), int(vrow[q]), int(y)) for q, y in zip(p, x)]
            names = dict(zip(vrow.tolist(), left.column("id").to_pylist()))
            owner = dict(zip(arow.tolist(), right.column("id").to_pylist()))
            return pa.table({"anchor_row": pa.array([a for a, _, _ in out], pa.int64()), "anchor_id": pa.array([owner[a] for a, _, _ in out], pa.int64()), "positive_row": pa.array([r for _, r, _ in out], pa.int64()), "positive_id": pa.array([names[r] for _, r, _ in out], pa.int64()), "positive_score": pa.array([x for _, _, x in out], pa.int64())})
        return pa.table({n: pa.array([], pa.int64()) for n in ("anchor_row", "anchor_id", "positive_row", "positive_id", "positive_score")})

    return run


def _negatives(scale: float, k: int, low: int, high: int) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            rows, members, most = _sides(left, right, scale)
            vid, vrow, vlab = _ids(left, "id"), _ids(left, "row"), _ids(left, "label")
            arow, alab = _ids(right, "row"), _ids(right, "label")
            # Scores of the anchor's positives; no whole number lies in the band of a negative one.
            asked = [[p for p in x if -(-low * p // 100) <= high * p // 100] for x in right.column("asked").to_pylist()]
            for at, lengths, order, bound in _lists(members, right.column("cell").to_numpy(), rows):
                want = [{p: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for p in asked[a]} for a in at]
                live = np.arange(len(at))

                def need(m: int) -> int:
                    """No row under this score is of use: under the band of each positive, or under its k rows."""
                    return min(max(-(-low * p // 100), int(x[-1]) if len(x) == k else -LONG) for p, (_, x) in want[m].items())

                for f in range(0, len(order), STEP):
                    live = live[np.array([bool(want[m]) and need(m) <= lengths[m] * bound[f] for m in live], dtype=bool)]
                    if not len(live):
                        break
                    part = order[f : f + STEP]
                    s = _held(_scores(rows[part], members[at[live]], most))
                    for j, m in enumerate(live):
                        x = s[:, j]
                        other = np.flatnonzero((vlab[part] != alab[at[m]]) & (x >= need(m)))
                        for p in want[m]:
                            # 100 x lies between low p and high p, in whole numbers: x from ceil(low p / 100) to floor(high p / 100).
                            fit = other[(x[other] >= -(-low * p // 100)) & (x[other] <= high * p // 100)]
                            if len(fit):
                                q, y = np.concatenate([want[m][p][0], part[fit]]), np.concatenate([want[m][p][1], x[fit]])
                                t = _top(y, vid[q], vrow[q], k)
                                want[m][p] = (q[t], y[t])
                for m, found in enumerate(want):
                    out += [(int(arow[at[m]]), p, int(vrow[r]), int(y)) for p, (q, x) in found.items() for r, y in zip(q, x)]
        names = dict(zip(_ids(left, "row").tolist(), left.column("id").to_pylist())) if left.num_rows else {}
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor_row", "positive_score", "negative_row", "negative_score"), cols)} | {"negative_id": pa.array([names[r] for r in cols[2]], pa.int64())})

    return run


def _ranked(df: DataFrame, by: list[str], score: str, identity: str, row: str, k: int) -> DataFrame:
    """The k first of each key by score descending, id, row, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(identity), row)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pairs(rows: DataFrame, anchors: DataFrame, blocks: int, groups: int) -> tuple:
    """Both sides by pair of blocks: a row goes to every group of anchors, an anchor to every block of rows; one task holds one pair."""
    left = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.groupBy("block", "group").cogroup(right.groupBy("block", "group"))


def mine(df: DataFrame, is_anchor: Column, scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK, anchor_block: int = ANCHORS, clusters: int = CLUSTERS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor among the rows of df (vec_id, label, embedding) and each of its first `positives`
    other rows of the same label, the first `negatives` rows of other labels whose score is from low to high per cent of the positive's. is_anchor reads `id`."""
    spark = df.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = usable(df)
    sample = rows.where(is_anchor).select("v", F.xxhash64("row").alias("h")).orderBy("h").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], out)
    c = centres(_matrix(sample.column("v"), scale), clusters)
    celled = rows.mapInArrow(_cells(c, scale), "id long, label long, v array<double>, row long, cell int")
    celled, blocks = dealt(written(celled, "cells"), block, "block")
    anchors, groups = dealt(celled.where(is_anchor).drop("block"), anchor_block, "group")
    anchors = written(anchors, "anchors")
    found = _pairs(celled.drop("cell"), anchors, blocks, groups).applyInArrow(_positives(scale, positives), "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long")
    pos = written(_ranked(found, ["anchor_row"], "positive_score", "positive_id", "positive_row", positives).drop("rank"), "positives")
    asked = pos.groupBy("anchor_row").agg(F.collect_set("positive_score").alias("asked"))  # at most `positives` of them
    second = anchors.join(asked.withColumnRenamed("anchor_row", "row"), "row")
    found = _pairs(celled.drop("cell"), second, blocks, groups).applyInArrow(_negatives(scale, negatives, low, high), "anchor_row long, positive_score long, negative_row long, negative_score long, negative_id long")
    neg = _ranked(found, ["anchor_row", "positive_score"], "negative_score", "negative_id", "negative_row", negatives)
    return pos.join(neg, ["anchor_row", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.withColumn("label", moved), F.col("id") % 100 == 0)


ORACLE_SQL = {
    "op13_hard_negatives": """WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.id <> b.id WHERE a.id % 100 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5"""
}
