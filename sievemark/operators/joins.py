"""Coverage, protocol, paired and lookup joins, and near-duplicate joins of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.tables import written
from .ordered import places

KEYED, BLOCK = 5, 16_384
"""Bits apart up to which near hashes are found by keys; hashes of a block where they are compared one by one."""


def expected_keys(manifest: DataFrame, views: list[str]) -> DataFrame:
    """Every sample with every declared view: the views are a list in the plan, each row is exploded."""
    return manifest.withColumn("view", F.explode(F.array(*map(F.lit, views))))


def coverage_join(manifest: DataFrame, ledger: DataFrame, role: str, views: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, missing): predictions of every expected key, and the keys without one; a null logit is missing, further ledger rows are ignored."""
    want = expected_keys(manifest.where(F.col("role") == role), views)
    have = ledger.where("raw_logit is not null").select("sample_id", "view", "view_pos", "raw_logit")
    return want.join(have, ["sample_id", "view"]), want.select("sample_id", "view").join(have, ["sample_id", "view"], "left_anti")


def protocol_join(manifest: DataFrame, ledger: DataFrame, registry: DataFrame, fields: list[str]) -> DataFrame:
    """(sample_id, view, problem): expected keys that are missing, and the first field that differs from the registry's."""
    reg = registry.select(F.col("case_id").alias("view"), *[F.col(f).alias(f"_{f}") for f in fields])
    want = manifest.select("sample_id").join(F.broadcast(reg))  # one row per case: a declared registry of tens of cases
    have = ledger.select("sample_id", "view", F.lit(True).alias("_here"), *fields)
    text = lambda c: F.to_json(F.struct(F.col(c).alias("x")))
    problem = F.when(F.col("_here").isNull(), "missing")
    for f in fields:
        problem = problem.when(~text(f).eqNullSafe(text(f"_{f}")), f)
    return want.join(have, ["sample_id", "view"], "left").withColumn("problem", problem).where("problem is not null").select("sample_id", "view", "problem")


def key_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, side): keys of only one side; `left` or `right`."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(True)), b.select(*keys).distinct().withColumn("_b", F.lit(True))
    return x.join(y, keys, "full_outer").where("_a is null or _b is null").select(*keys, F.when(F.col("_b").isNull(), "left").otherwise("right").alias("side"))


def assert_same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    """Fails with up to five examples of each side."""
    d = key_differences(a, b, keys)
    found = {side: d.where(F.col("side") == side).orderBy(*keys).limit(5).collect() for side in ("left", "right")}
    if any(found.values()):
        raise ValueError("keys differ: " + "; ".join(f"only {s}: {[tuple(r)[:-1] for r in x]}" for s, x in found.items() if x))


def pair(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("sample_id", "view")) -> DataFrame:
    """(sample_id, view, label, group_id, line, left, right); a label or group that differs fails."""
    y = b.select(*keys, F.col("label").alias("_l"), F.col("group_id").alias("_g"), F.col("probability").alias("right"))
    j = a.select(*keys, "label", "group_id", "line", F.col("probability").alias("left")).join(y, list(keys))
    same = (F.col("label") == F.col("_l")) & (F.col("group_id") == F.col("_g"))
    return j.withColumn("label", F.when(same, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("label or group differs: "), "sample_id")).cast("int"))).drop("_l", "_g")


def paired_views(df: DataFrame, base: str, stress: list[str]) -> DataFrame:
    b = df.where(F.col("view") == base).select("sample_id", F.col("probability").alias("base_p"))
    return df.where(F.col("view").isin(stress)).select("sample_id", "view", F.col("probability").alias("stress_p")).join(b, "sample_id")


def keyed(rows: DataFrame, name: str, distance: int) -> DataFrame:
    """rows with (band, bits) of every key of their hash `name`. Rows are short next to their keys, and adaptive execution would put them into few tasks, by their size before; so they are dealt to
    as many tasks as a shuffle has; by more than the columns, as Spark leaves out a shuffle by what rows lie by already."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_bits", S.bits_of(F.col(name))).repartition(tasks, "_bits", *rows.columns)
    return dealt.select(*rows.columns, F.inline(S.near_keys(F.col("_bits"), distance)))


def banded(df: DataFrame, distance: int, id_col: str = "sample_id") -> DataFrame:
    """(id, phash, role, content_sha256, band, bits) of well-formed hashes: rows that share (band, bits) are candidates."""
    ok = df.where(S.is_hex(F.col("phash"), 16))
    return keyed(ok.select(F.col(id_col).alias("id"), "phash", "role", "content_sha256"), "phash", distance)


def _close(distance: int):
    """Of rows (i, j, l, r), two blocks of hashes each: the pairs at most `distance` bits apart, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, left, right in zip(*(batch.column(c) for c in ("i", "j", "l", "r"))):
                l, r = left.values.to_numpy(), right.values.to_numpy()
                step = max(1, (1 << 18) // len(r))
                bits, apart = np.empty((step, len(r)), np.uint64), np.empty((step, len(r)), np.uint8)
                for f in range(0, len(l), step):
                    k = len(l[f : f + step])
                    np.bitwise_xor(l[f : f + k, None].view(np.uint64), r.view(np.uint64), out=bits[:k])
                    np.bitwise_count(bits[:k], out=apart[:k])
                    x, y = np.divmod(np.flatnonzero(apart[:k] <= distance), len(r))
                    if i == j:
                        x, y = x[x + f < y], y[x + f < y]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(l[x + f]), pa.array(r[y]), pa.array(apart[x, y].astype(np.int32))], names=["p", "q", "distance"])

    return run


def near_hashes(hashes: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """(p, q, distance): each pair of the distinct `bits` of hashes at most `distance` apart, once; every pair is compared, two blocks of hashes in a task."""
    n = max(1, -(-hashes.count() // block))
    blocks = hashes.groupBy(F.pmod(F.xxhash64("bits"), F.lit(n)).cast("int").alias("i")).agg(F.collect_list("bits").alias("l"))  # `block` hashes, more or less
    left = blocks.select("i", "l", F.explode(F.sequence("i", F.lit(n - 1))).alias("j"))
    pairs = left.join(blocks.select(F.col("i").alias("j"), F.col("l").alias("r")), "j").repartition(min(n * (n + 1) // 2, 2000), "i", "j")
    return pairs.select("i", "j", "l", "r").mapInArrow(_close(distance), "p long, q long, distance int")


def near_pairs(df: DataFrame, distance: int, cross: str | None = "role") -> DataFrame:
    """(a, b, distance): each pair of rows of different contents, and roles if `cross`, at most `distance` bits apart, once.

    Equal hashes are collapsed to one row per (phash, role, content) with the smallest id, so that copies don't multiply. Up to KEYED bits apart, rows meet by exact keys: two hashes that differ in
    `distance` bits share one (`near_keys`). Beyond, keys are so narrow that most pairs share one; there all pairs of distinct hashes are compared, in blocks.
    """
    rows = df.groupBy("phash", "role", "content_sha256").agg(F.min("sample_id").alias("sample_id"))
    apart = lambda l, r: (F.col(f"{l}.id") < F.col(f"{r}.id")) & (F.col(f"{l}.content_sha256") != F.col(f"{r}.content_sha256")) & (F.col(f"{l}.{cross}") != F.col(f"{r}.{cross}") if cross else F.lit(True))
    if distance > KEYED:
        ok = rows.where(S.is_hex(F.col("phash"), 16))
        x = written(ok.select(F.col("sample_id").alias("id"), "role", "content_sha256", S.bits_of(F.col("phash")).alias("bits")), "hashes")
        hashes = x.select("bits").distinct()
        found = near_hashes(hashes, distance)
        same = hashes.select(F.col("bits").alias("p"), F.col("bits").alias("q"), F.lit(0).alias("distance"))
        ends = F.array(F.struct("p", "q", "distance"), F.struct(F.col("q").alias("p"), F.col("p").alias("q"), "distance"))
        met = found.select(F.inline(ends)).unionByName(same)
        met = x.alias("l").join(met, F.col("l.bits") == F.col("p")).join(x.alias("r"), F.col("r.bits") == F.col("q")).where(apart("l", "r"))
        return met.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), "distance")
    x = banded(rows, distance)
    left, right = x.alias("l"), x.alias("r")
    on = (F.col("l.band") == F.col("r.band")) & (F.col("l.bits") == F.col("r.bits")) & apart("l", "r")
    h = S.hamming(F.col("l.phash"), F.col("r.phash"))
    return left.join(right, on).where(h <= distance).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), h.alias("distance")).distinct()


def decontaminate(df: DataFrame, protected: DataFrame, distance: int = 4) -> DataFrame:
    """(sample_id, reason): rows of df too near to a protected row; `exact` content goes before `near`."""
    exact = df.join(protected.select("content_sha256").distinct(), "content_sha256", "left_semi").select("sample_id", F.lit("exact").alias("reason"))
    keys = lambda x, name: keyed(x.where(S.is_hex(F.col("phash"), 16)).select(F.col("phash").alias(name)).distinct(), name, distance)
    met = keys(df, "phash").join(keys(protected, "p"), ["band", "bits"]).where(S.hamming(F.col("phash"), F.col("p")) <= distance).select("phash").distinct()
    near = df.join(met, "phash", "left_semi").select("sample_id", F.lit("near").alias("reason"))
    return exact.unionByName(near).groupBy("sample_id").agg(F.min("reason").alias("reason"))


def exclude_hashes(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.join(other.select("content_sha256").distinct(), "content_sha256", "left_anti")


def rehydrate(inventory: DataFrame, files: DataFrame, allow_missing: bool = False) -> DataFrame:
    """inventory with the first path, in order, of each content hash. A missing file is an error unless allowed: then its path is null."""
    first = files.groupBy("content_sha256").agg(F.min("path").alias("path"))
    out = inventory.drop("path").join(first, "content_sha256", "left")
    if allow_missing:
        return out
    return out.withColumn("path", F.coalesce("path", F.raise_error(F.concat(F.lit("no file for "), "content_sha256")).cast("string")))


def enrich(df: DataFrame, attempts: DataFrame, key: str, columns: dict[str, object], seq: str) -> DataFrame:
    """df with columns of the last successful attempt of its key, or defaults."""
    last = attempts.where("error is null").groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("_a"))
    return df.join(last, key, "left").withColumns({c: F.coalesce(F.col(f"_a.{c}"), F.lit(v)) for c, v in columns.items()}).drop("_a")


def pick_partner(df: DataFrame, pool: DataFrame, salt: str) -> DataFrame:
    """df with `partner`: the pool row (by id order) at hash modulo n; the next one where that is the row itself and there is another.

    Pool rows are numbered in parts of the order of ids, not in one task.
    """
    numbered = places(pool.select("sample_id"), [], "sample_id", "place")
    n = pool.agg(F.count(F.lit(1)).alias("n"))
    rows = df.crossJoin(n).withColumn("_i", (S.hash_number(salt, F.col("sample_id")) % F.greatest("n", F.lit(1))).cast("long"))  # one row: the count
    p = numbered.select(F.col("place").alias("_p"), F.col("sample_id").alias("_id"))
    rows = rows.join(p.select(F.col("_p").alias("_i"), F.col("_id").alias("_one")), "_i", "left")
    rows = rows.withColumn("_j", F.when((F.col("_one") == F.col("sample_id")) & (F.col("n") > 1), (F.col("_i") + 1) % F.col("n")).otherwise(F.col("_i")))
    return rows.join(p.select(F.col("_p").alias("_j"), F.col("_id").alias("partner")), "_j", "left").drop("_i", "_j", "_one", "n")


def strict_lookup(ledger: DataFrame, manifest: DataFrame) -> DataFrame:
    """ledger with the manifest's label and group; a sample that isn't in the manifest fails."""
    m = manifest.select("sample_id", "label", "group_id", F.lit(True).alias("_here"))
    here = F.when(F.col("_here"), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("not in the manifest: "), "sample_id")).cast("int"))
    return ledger.join(m, "sample_id", "left").withColumn("label", here).drop("_here")


def pending(manifest: DataFrame, views: list[str], ledger: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Keys still to be scored; rows with an error count as done unless they are to be tried again."""
    done = ledger.where("error is null") if retry_errors else ledger
    return expected_keys(manifest.select("sample_id"), views).join(done.select("sample_id", "view"), ["sample_id", "view"], "left_anti")


def common_support(a: DataFrame, b: DataFrame) -> DataFrame:
    """(sample_id, view) of samples of both and of views that both models have for all of those samples."""
    both = a.select("sample_id", "view").distinct().join(b.select("sample_id", "view").distinct(), ["sample_id", "view"])
    samples = a.select("sample_id").distinct().join(b.select("sample_id").distinct(), "sample_id")
    n = samples.agg(F.count(F.lit(1)).alias("n"))
    views = both.groupBy("view").agg(F.count(F.lit(1)).alias("k")).crossJoin(n).where("k = n").select("view")  # one row: the count
    return both.join(views, "view", "left_semi").select("sample_id", "view")


def weighted_draw(draws: DataFrame, weights: DataFrame, u: str = "u") -> DataFrame:
    """draws (with u in [0, 1)) and the source whose interval of the cumulative weights holds u * total.

    weights (source, weight) has a row per source; cells of equal width make the range join an equi-join.
    """
    cells = 256
    total = weights.agg(F.sum("weight").alias("total"))
    w = weights.withColumn("hi", F.sum("weight").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, 0))).crossJoin(total)  # one row
    w = w.withColumn("lo", (F.col("hi") - F.col("weight")) / F.col("total")).withColumn("hi", F.col("hi") / F.col("total"))
    cut = w.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    return draws.withColumn("cell", F.floor(F.col(u) * cells)).join(cut.select("source", "lo", "hi", "cell"), "cell").where((F.col(u) >= F.col("lo")) & (F.col(u) < F.col("hi"))).drop("cell", "lo", "hi")
