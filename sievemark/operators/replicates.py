"""Bootstrap replicates by a splitting tree: how often each of n clusters is drawn in n draws with replacement, for all replicates at once.

The n draws of a replicate are split between the halves of the clusters' order, a binomial draw, and on down to LEAF clusters, which share theirs by a multinomial draw. A node's
random numbers come from the seed, the group and the node's ends, so a task that holds a stretch of the order walks only to it, and gets the same counts as any other would: there is no
draw to shuffle, and every replicate's draws sum to n exactly. Tasks hand on a sum for each replicate, never rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import PART, attach, in_parts

LEAF = 64


def generator(seed: int, *parts: object) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32("\x00".join(map(str, parts)).encode()), *[p for p in parts if isinstance(p, int) and p >= 0]])


def tree_counts(first: int, last: int, n: int, replicates: int, seed: int, group: str) -> np.ndarray:
    """Replicates by clusters first to last - 1 of n: how often each is drawn."""
    out = np.zeros((replicates, last - first), np.int64)
    stack = [(0, n, np.full(replicates, n, np.int64))]
    while stack:
        a, b, m = stack.pop()
        if b <= first or a >= last:
            continue
        rng = generator(seed, group, a, b)
        if b - a <= LEAF:
            counts = rng.multinomial(m, np.full(b - a, 1 / (b - a)))
            x, y = max(a, first), min(b, last)
            out[:, x - first : y - first] = counts[:, x - a : y - a]
        else:
            mid = (a + b) // 2
            left = rng.binomial(m, (mid - a) / (b - a))
            stack += [(a, mid, left), (mid, b, m - left)]
    return out


def placed(clusters: DataFrame, by: list[str], key: str) -> DataFrame:
    """clusters in parts, with the place of each part's first row within its group (_start) and the group's size (_n)."""
    parts = in_parts(clusters, [*by, key], "clusters")
    per = parts.groupBy(*by, PART).agg(F.count(F.lit(1)).alias("_c"))
    per = per.select(*by, PART, F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_c").over(Window.partitionBy(*by)).alias("_n"))
    return attach(parts, per, [*by, PART])


def _draws(table: pa.Table, by: list[str], key: str, replicates: int, seed: int) -> tuple[pa.Table, np.ndarray, str]:
    table = table.take(pc.sort_indices(table, [(key, "ascending")], null_placement="at_start"))
    group = "\x00".join(str(table.column(b)[0].as_py()) for b in by)
    start, n = int(table.column("_start")[0].as_py()), int(table.column("_n")[0].as_py())
    return table, tree_counts(start, start + len(table), n, replicates, seed, group), group


def replicate_sums(clusters: DataFrame, by: list[str], key: str, kernel: Callable[[pa.Table, np.ndarray, np.random.Generator], dict[str, np.ndarray]], names: list[str], replicates: int, seed: int) -> DataFrame:
    """(*by, rep, *names): what kernel gives for each part's clusters and counts (replicates by clusters), as one number for each name and replicate, summed over parts."""
    cols = placed(clusters, by, key)
    kinds = dict(cols.dtypes)
    schema = ", ".join([f"{b} {kinds[b]}" for b in by] + ["rep int"] + [f"{n} double" for n in names])

    def run(table: pa.Table) -> pa.Table:
        table, counts, group = _draws(table, by, key, replicates, seed)
        found = kernel(table, counts, generator(seed, "kernel", group, int(table.column("_start")[0].as_py())))
        same = {b: pa.array([table.column(b)[0].as_py()] * replicates, table.column(b).type) for b in by}
        return pa.table(same | {"rep": pa.array(np.arange(replicates, dtype=np.int32))} | {n: pa.array(np.asarray(found[n], float)) for n in names})

    return cols.groupBy(*by, PART).applyInArrow(run, schema).groupBy(*by, "rep").agg(*[F.sum(n).alias(n) for n in names])


def replicate_counts(clusters: DataFrame, by: list[str], key: str, replicates: int, seed: int) -> DataFrame:
    """(*by, key, counts): the draws of each cluster in all replicates, as 32-bit numbers in one binary value."""
    cols = placed(clusters.select(*by, key), by, key)
    kinds = dict(cols.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table, counts, _ = _draws(table, by, key, replicates, seed)
        return pa.table({b: table.column(b) for b in [*by, key]} | {"counts": pa.array([c.tobytes() for c in np.ascontiguousarray(counts.T, dtype="<u4")], pa.binary())})

    return cols.groupBy(*by, PART).applyInArrow(run, ", ".join(f"{b} {kinds[b]}" for b in [*by, key]) + ", counts binary")


def _combined(keys: list[str]):
    """Rows of equal keys within a batch as one, their counts added: a score that a third of the rows share is a row for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list] = {}
            columns = [batch.column(k).to_pylist() for k in keys]
            for i, key in enumerate(zip(*columns)):
                w = np.frombuffer(batch.column("counts")[i].as_buffer(), "<u4")
                if key in sums:
                    sums[key][1] = sums[key][1] + w
                else:
                    sums[key] = [i, w]
            first = batch.take(pa.array([i for i, _ in sums.values()], pa.int64()))
            yield pa.RecordBatch.from_arrays([*[first.column(k) for k in keys], pa.array([w.astype("<u4").tobytes() for _, w in sums.values()], pa.binary())], names=[*keys, "counts"])

    return run


def replicate_auc(rows: DataFrame, by: list[str], replicates: int) -> DataFrame:
    """(*by, rep, auc) of rows (label, probability, counts): one pass over the order of scores, in which a row weighs as its counts say; a part hands on its area and its sums of both classes,
    and what lies below a part is added by replicate. Null where a replicate drew one class only."""
    keys = [*by, "label", "probability"]
    slim = rows.select(*keys, "counts").mapInArrow(_combined(keys), ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", counts binary")
    parts = in_parts(slim, [*by, "probability"], "auc-rows")
    kinds = dict(parts.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("probability", "ascending")], null_placement="at_start"))
        x = table.column("probability").combine_chunks()
        scores = x.fill_null(-np.inf).to_numpy(zero_copy_only=False)
        label = table.column("label").to_numpy()
        ends = np.append(np.flatnonzero(scores[1:] != scores[:-1]) + 1, len(scores))
        pos, neg, area, a = np.zeros(replicates), np.zeros(replicates), np.zeros(replicates), 0
        counts = table.column("counts")
        for b in ends:  # a run of equal scores
            p, q = np.zeros(replicates), np.zeros(replicates)
            for i in range(a, b):
                w = np.frombuffer(counts[i].as_buffer(), "<u4")
                if label[i] == 1:
                    p += w
                else:
                    q += w
            area += p * (neg + q / 2)
            pos, neg, a = pos + p, neg + q, b
        same = {k: pa.array([table.column(k)[0].as_py()] * replicates, table.column(k).type) for k in by}
        return pa.table(same | {PART: pa.array([table.column(PART)[0].as_py()] * replicates, pa.int32()), "rep": pa.array(np.arange(replicates, dtype=np.int32)), "area": pa.array(area), "pos": pa.array(pos), "neg": pa.array(neg)})

    per = parts.groupBy(*by, PART).applyInArrow(run, ", ".join([f"{k} {kinds[k]}" for k in by] + [f"{PART} int, rep int, area double, pos double, neg double"]))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*by, "rep").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    per = per.withColumn("area", F.col("area") + F.col("pos") * below)
    return per.groupBy(*by, "rep").agg(F.try_divide(F.sum("area"), F.sum("pos") * F.sum("neg")).alias("auc"))
