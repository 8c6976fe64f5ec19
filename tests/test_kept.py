"""Kept indexes and files: near-duplicate keys over several batches, shards, images in folders, registries."""

import json

import pytest
from pyspark.sql import functions as F

from sievemark.operators import integrity, joins, ordered, sampling
from sievemark.operators.hash_index import HashIndex
from sievemark.sources import manifests as R

SCHEMA = "sample_id string, phash string, content_sha256 string, role string"


def rows_of(seed, n, role, flips=0):
    import random

    r, base = random.Random(seed), random.Random(1)
    known = [base.getrandbits(64) for _ in range(60)]
    out = []
    for i in range(n):
        h = r.choice(known) if r.random() < 0.5 else r.getrandbits(64)
        for b in r.sample(range(64), r.randrange(flips + 1)):
            h ^= 1 << b
        out.append((f"{role}{seed}-{i}", f"{h:016x}" if i % 9 else "bad", f"c{r.randrange(400)}" if i % 7 else None, role))
    return out


def test_index_over_batches(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    first, second = rows_of(2, 150, "test", 2), rows_of(3, 150, "calibration", 2)
    new, more = frame(rows_of(4, 300, "train", 5)), frame(rows_of(5, 300, "train", 3))
    index = HashIndex(spark, "kept", f"{tmp_path}/index", buckets=8)
    index.add(frame(first))
    found = lambda df: sorted(tuple(r) for r in df.collect())
    assert found(index.decontaminate(new)) == found(joins.decontaminate(new, frame(first)))
    again = HashIndex(spark, "kept", f"{tmp_path}/index", buckets=8)  # opened by another session
    again.add(frame(second))
    again.add(frame(second))
    both = frame(first + second)
    for df in (new, more):
        assert found(again.decontaminate(df)) == found(joins.decontaminate(df, both)) != []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = again.decontaminate(new)._jdf.queryExecution().sparkPlan().toString(), again.decontaminate(new)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The scans of the index are read in their buckets, and no exchange stands over them.
    lines = plan[1].split("\n")
    for i, line in enumerate(lines):
        if "FileScan" in line and "kept" in line:
            assert "Bucketed: true" in line and not any("Exchange" in x for x in lines[max(0, i - 3) : i])


def test_bounded_lists(spark):
    rows = [(f"s{i:05d}", "one" if i < 4000 else f"c{i // 2}", ("train", "test")[i % 2] if i < 4100 else "train", i) for i in range(5000)] + [("s00001", "x", "test", 9)]
    m = spark.createDataFrame(rows, "sample_id string, content_sha256 string, role string, line int").withColumn("group_id", F.col("sample_id"))
    got = {(r.code, r.key): (r.n, r.roles, r.members.split(",")) for r in integrity.overlap_issues(m, 3, "line").collect()}
    assert got["exact_overlap", "one"] == (4000, "test,train", ["s00000", "s00001", "s00002"])
    assert got["duplicate_sample_id", "s00001"][0] == 2 and len([k for k in got if k[0] == "exact_overlap"]) == 51
    found = sampling.examples(m, ["sample_id"], 5).first()
    assert found.total == 5001 and [x.sample_id for x in found.examples] == ["s00000", "s00001", "s00001", "s00002", "s00003"]
    assert sampling.examples(m.limit(0), ["sample_id"], 5).count() == 0
    # The lists are cut before they are shuffled.
    plan = ordered.first_k(m, ["content_sha256"], ["line"], 3, F.col("sample_id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_shards(spark, tmp_path):
    R.write_corpus(spark.range(1000).withColumn("x", F.col("id") * 2).repartition(2), f"{tmp_path}/c", 300, 50)
    rows = R.shard_report(spark, f"{tmp_path}/c").collect()
    assert sum(r.rows for r in rows) == 1000 and max(r.rows for r in rows) <= 300 and max(r.largest_group for r in rows) <= 50 and all(r.row_groups >= r.rows / 50 for r in rows)
    import hashlib

    assert all(hashlib.sha256((tmp_path / "c" / r.file).read_bytes()).hexdigest() == r.sha256 and (tmp_path / "c" / r.file).stat().st_size == r.bytes for r in rows)


def test_images_in_folders(spark, tmp_path):
    for name in ("gen-a/AI/x.JPG", "gen-a/real/deep/y.tiff", "gen-b/Synthetic/z.avif", "gen-b/0/t.txt"):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_bytes(name.encode())
    got = {r.path.rsplit("/", 1)[1]: (r.source, r.label) for r in R.manifest_from_files(spark, f"{tmp_path}/r", "d", "test").collect()}
    assert got == {"x.JPG": ("gen-a", 1), "y.tiff": ("gen-a", 0), "z.avif": ("gen-b", 1)}
    (tmp_path / "s/photo/gen-c").mkdir(parents=True)
    (tmp_path / "s/photo/gen-c/q.Png").write_bytes(b"q")
    r = R.manifest_from_files(spark, f"{tmp_path}/s", "d", "test", "label/generator").first()
    assert (r.source, r.label, r.group_id) == ("gen-c", 0, "d:real:gen-c")
    with pytest.raises(ValueError, match="no supported files"):
        R.manifest_from_files(spark, f"{tmp_path}/r/gen-b/0", "d", "test")
    with pytest.raises(ValueError, match="layout"):
        R.manifest_from_files(spark, f"{tmp_path}/s", "d", "test", "other")


def test_registry_file(spark, tmp_path):
    doc = {"cases": {"clean": {"family": "none"}, "jpeg": {"family": "codec", "operations": [{"op": "jpeg", "quality": 75}]}}, "profiles": {"p": ["clean", "jpeg"], "bad": ["jpeg"], "worse": ["clean", "blur"]}}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    assert [(r.case_id, r.position) for r in R.read_registry(spark, f"{tmp_path}/r.json", "p").collect()] == [("clean", 0), ("jpeg", 1)]
    for name in ("bad", "worse", "none"):
        with pytest.raises(ValueError):
            R.read_registry(spark, f"{tmp_path}/r.json", name)


def test_keys_are_dealt_before_they_are_made(spark):
    """A table that fits into one task is not made into 35 times its rows in that task, neither in the index nor in the joins."""
    rows = spark.createDataFrame(rows_of(6, 4000, "test", 2), SCHEMA)
    index = HashIndex.__new__(HashIndex)
    index.distance = 4
    one = rows.groupBy("phash", "role", "content_sha256").agg(F.min("sample_id").alias("sample_id"))
    for keys in (index._keys(rows, "p"), joins.banded(one, 4)):
        per = keys.groupBy(F.spark_partition_id().alias("task")).count().collect()
        n = sum(r["count"] for r in per)
        assert n % 35 == 0 and len(per) == 4 and max(r["count"] for r in per) < n / 2
    reach = joins.decontaminate(rows, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert reach.count("RepartitionByExpression") == 2
