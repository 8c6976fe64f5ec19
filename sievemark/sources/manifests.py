"""Scans and sinks of manifests, ledgers, registries and corpora."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from .quoted import read_quoted

REQUIRED = ("sample_id", "path", "label", "dataset", "source", "group_id", "role", "content_sha256", "phash")
ROLES = ("train", "calibration", "test")
LEDGER = "sample_id string, view string, raw_logit double, error string, model_id string, model_revision string, model_input_size int, model_resize_short_edge int, attack_id string, attack_family string, attack_severity string, attack_operations array<map<string,string>>, probe_fit string"
SCORED = ("sample_id", "view", "label", "dataset", "source", "group_id", "role", "width", "height", "raw_logit", "probability", "prediction", "model_id", "resolution_bucket", "correct")


def stripped(c: str):
    return F.regexp_replace(F.col(c), r"^\s+|\s+$", "")


def fail_if_any(bad: DataFrame, what: str, keys: list[str]) -> None:
    """Raises with the count and up to five examples; both come from one run of the input."""
    part = F.pmod(F.hash(*keys), F.lit(5)).alias("_p")  # five examples at most, whatever there is
    found = bad.select(*keys, part).groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*keys)).alias("_first")).collect()
    n = sum(r["n"] for r in found)
    if n:
        raise ValueError(f"{n} {what}: {sorted((tuple(r['_first']) for r in found), key=str)[:5]}")


def read_manifest(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a CSV manifest with header, whose fields may have line feeds in quotes; large files are read by several tasks. Extra columns stay as text; relative paths are taken
    from the manifest's folder.

    Rows with a label other than 0 and 1 or an unknown role are rejects, with their _file and _line; strict raises where there are any."""
    raw = read_quoted(spark, path)
    lacking = [c for c in REQUIRED if c not in raw.columns]
    if lacking:
        raise ValueError(f"columns missing: {lacking}")
    own = ("_file", "_line")
    rows = raw.select(*[stripped(c).alias(c) for c in raw.columns if c not in own], *own).withColumn("label", F.col("label").try_cast("int"))
    for c in ("width", "height"):
        if c in raw.columns:
            rows = rows.withColumn(c, F.col(c).try_cast("int"))
    base = os.path.dirname(path.rstrip("/"))
    rows = rows.withColumn("path", F.when(F.col("path").rlike("^(/|[a-z0-9]+:/)"), F.col("path")).otherwise(F.concat(F.lit(base + "/"), "path")))
    problem = F.when(~F.coalesce(F.col("label").isin(0, 1), F.lit(False)), "label").when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "role")
    rows = rows.withColumn("_problem", problem)
    rejects = rows.where("_problem is not null")
    if strict:
        fail_if_any(rejects, "bad rows", ["sample_id", "_problem", "_line"])
    return rows.where("_problem is null").drop("_problem", *own), rejects


def write_manifest(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Core columns first, extras sorted, internal ones (_x) left out; an empty manifest is refused. Spark's job commit makes it all or nothing."""
    if df.isEmpty():
        raise ValueError("an empty manifest is not written")
    extras = sorted(c for c in df.columns if c not in REQUIRED and not c.startswith("_"))
    out = df.select(*REQUIRED, *extras)
    (out.write.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else out.write.format(fmt).save(path))


def read_ledger(spark: SparkSession, path: str, schema: str = LEDGER) -> DataFrame:
    """A JSON-lines ledger; blank lines are skipped, malformed ones fail with their file and text."""
    full = T.StructType.fromDDL(schema).add("_corrupt", "string")
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    first = rows.columns[0]
    where = F.concat_ws(": ", F.lit("malformed line"), F.col("_metadata.file_path"), F.substring("_corrupt", 1, 200))
    checked = F.when(F.col("_corrupt").isNotNull(), F.raise_error(where).cast(rows.schema[first].dataType)).otherwise(F.col(first))
    return rows.withColumn(first, checked).drop("_corrupt")


def write_ledger(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.json(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a report as JSON lines in its folder; NaN becomes null."""
    for name, df in tables.items():
        nan_to_null(df).write.option("ignoreNullFields", False).json(f"{path}/{name}")


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """A calibrated ledger from CSV; a repeated (sample_id, view) fails."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.withColumns({"label": F.col("label").cast("int"), "probability": F.col("probability").cast("double")})
    fail_if_any(rows.groupBy("sample_id", "view").count().where("count > 1"), "repeated keys", ["sample_id", "view"])
    return rows


def write_scored(df: DataFrame, path: str, threshold: float, fmt: str = "parquet") -> None:
    out = df.withColumns({
        "prediction": (F.col("probability") >= threshold).cast("int"), "resolution_bucket": S.resolution_bucket(F.col("width"), F.col("height")),
        "correct": S.correct(F.col("label"), F.col("probability"), threshold),
    }).select(*SCORED)
    (out.write.option("header", True) if fmt == "csv" else out.write).format(fmt).save(path)


def load_registry(spark: SparkSession, cases: dict[str, dict], profile: list[str]) -> DataFrame:
    """(case_id, family, severity, operations, position) of a profile: declared cases, tens of them. Unknown cases fail, as does a profile without `clean`."""
    unknown = [c for c in profile if c not in cases]
    if unknown or "clean" not in profile:
        raise ValueError(f"unknown cases {unknown}, or no clean case")
    rows = [(c, cases[c]["family"], cases[c].get("severity", ""), [{k: str(v) for k, v in op.items()} for op in cases[c].get("operations", [])], i) for i, c in enumerate(profile)]
    return spark.createDataFrame(rows, "case_id string, family string, severity string, operations array<map<string,string>>, position int")


def read_registry(spark: SparkSession, path: str, profile: str) -> DataFrame:
    """From a JSON document {cases, profiles}, read through Spark."""
    doc = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if profile not in doc["profiles"]:
        raise ValueError(f"unknown profile {profile}")
    return load_registry(spark, doc["cases"], doc["profiles"][profile])


def scan_candidates(corpus: DataFrame, columns: list[str]) -> DataFrame:
    """Only these columns reach the Parquet scan."""
    return corpus.select(*columns)


def fetch_payload(selected: DataFrame, corpus: DataFrame, key: str = "content_sha256") -> DataFrame:
    """Payload rows of the selected keys. Spark broadcasts the keys where they are few, as its statistics say."""
    return corpus.join(selected.select(key).distinct(), key, "left_semi")


# The suffixes of images.
IMAGES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff", "avif")
LAYOUTS: dict[str, tuple[int, int]] = {"generator/label": (1, 2), "label/generator": (2, 1)}


def any_case(suffixes: tuple[str, ...]) -> str:
    """A glob of files with one of the suffixes, in capitals or not."""
    each = ("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes)
    return "*.{" + ",".join(each) + "}"


def manifest_from_files(spark: SparkSession, root: str, dataset: str, role: str, layout: str | Callable = "generator/label", suffixes: tuple[str, ...] = IMAGES) -> DataFrame:
    """A manifest of the files under root, two folders or more below it. layout: one of LAYOUTS, by the first two folders, or a function from the path's parts to (source, label name).
    Other paths fail, and so does a root without such files."""
    if isinstance(layout, str):
        if layout not in LAYOUTS:
            raise ValueError(f"layout must be one of {sorted(LAYOUTS)}")
        at = LAYOUTS[layout]
        layout = lambda parts: tuple(F.try_element_at(parts, F.lit(i)) for i in at)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", any_case(suffixes)).load(root)
    if files.select("path").isEmpty():
        raise ValueError(f"no supported files beneath {root}")
    rel = F.substring_index("path", "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    parts = F.split(rel, "/")
    source, name = layout(parts)
    label = S.label_alias(name)
    ok = F.when((F.size(parts) >= 3) & label.isNotNull(), label).otherwise(F.raise_error(F.concat(F.lit("unknown layout: "), "path")).cast("int"))
    digest = F.sha2("content", 256)
    return files.select(
        S.content_id(dataset, rel, digest).alias("sample_id"), "path", ok.alias("label"), F.lit(dataset).alias("dataset"), source.alias("source"), S.group_name(F.lit(dataset), ok, source).alias("group_id"),
        F.lit(role).alias("role"), digest.alias("content_sha256"), F.col("length").alias("n_bytes"), S.sniff(F.col("content"), F.element_at(F.split("path", r"\."), -1)).alias("format"),
    )


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """A CSV inventory, gzip or plain: it must have content_sha256 and no path."""
    rows = spark.read.option("header", True).csv(path)
    if "content_sha256" not in rows.columns or "path" in rows.columns:
        raise ValueError("an inventory has content_sha256 and no path")
    return rows


def unpivot_models(df: DataFrame, ids: list[str], columns: list[str], prefix: str = "images/") -> DataFrame:
    """A row per (ids, model) whose value starts with the prefix."""
    return df.unpivot(ids, columns, "model", "value").where(F.col("value").startswith(prefix))


def unpivot_slots(df: DataFrame, keep: list[str], fields: list[str], n: int = 2) -> DataFrame:
    """A row per slot: field1..fieldn become field."""
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), *[F.col(f"{f}{i}").alias(f) for f in fields]) for i in range(1, n + 1)])
    return df.select(*keep, F.explode(slots).alias("s")).select(*keep, "s.*")


def write_corpus(df: DataFrame, path: str, rows_a_file: int = 1_000_000, rows_a_group: int = 100_000) -> None:
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).option("parquet.block.row.count.limit", rows_a_group).parquet(path)


def shard_report(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, row_groups, largest_group, bytes, sha256) of each shard: rows come from the footers, so no data is decoded, and each file is read once. A file must fit a task, as for any digest of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                content = content.as_buffer()
                meta = pq.read_metadata(pa.BufferReader(content))
                groups = [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
                out.append((file, meta.num_rows, len(groups), max(groups, default=0), content.size, hashlib.sha256(content).hexdigest()))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 4, pa.string()))], names=["file", "rows", "row_groups", "largest_group", "bytes", "sha256"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, "file string, rows long, row_groups long, largest_group long, bytes long, sha256 string")


def read_attempts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_ledger(spark, path, schema).where("error is null or error = ''")


def write_duplicates(df: DataFrame, path: str) -> None:
    df.orderBy("content_sha256", "repo", "locator").write.option("compression", "gzip").json(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest): the same for any order and partitioning of the rows."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("digest"))


def file_fingerprints(spark: SparkSession, paths: str | list[str], names: str = "*") -> DataFrame:
    """(path, sha256) of the files at paths, and below them where they are folders."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(paths).select("path", F.sha2("content", 256).alias("sha256"))
