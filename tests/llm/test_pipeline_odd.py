"""The pipeline's stages one after the other on odd rows, with clashing columns, and on an empty table."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["digest", "row", "key", "bands", "keep", "size", "rank", "slot", "ids", "score", "text_sha256", "part", "value", "copies", "taken"]


def prose(rng, n):
    return " ".join(f"w{rng.randrange(600)}x" for _ in range(n))


def odd_rows():
    rng = random.Random(4)
    long = prose(rng, 20_000)
    near = prose(rng, 80)
    texts = [None, "", " \n\t", "a", "é ü　ß \U0001f600", long, long, near, near + " more", "\\### x </turn> <b>\r\n", "\x00nul\x00"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 0) for i, t in enumerate(texts)]
    rows += [(100 + i, prose(rng, 60), "en", f"s{i % 3}", 0) for i in range(20)]
    rows += [(200 + i, prose(rng, 30) + " vlorpat " + prose(rng, 30), "en", "s1", 0) for i in range(40)]
    return rows + [rows[9], rows[9], (None, "no id", None, None, None), (None, "no id", None, None, None)]


def stages(spark, docs, folder, labels):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        seen, docs = docs, corpus_pipeline.written(stage(spark, docs, str(folder)), name)
        yield name, seen, docs


def test_odd_rows(spark, tmp_path):
    rows = odd_rows()
    labels = [(r[0], 1, int(r[0] >= 200)) for r in rows if r[0] is not None and r[0] >= 7] + [(7, None, None), (None, 1, 1), (100, 1, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in CLASH})
    kept = {}
    for name, seen, out in stages(spark, docs, tmp_path, labels):
        if name != "byte_bpe":
            assert out.columns == docs.columns
        assert out.select("doc_id").distinct().join(seen.select("doc_id").distinct(), "doc_id", "left_anti").where("doc_id is not null").count() == 0
        kept[name] = [(r.doc_id, r.text) for r in out.collect()] if name != "byte_bpe" else [(r.doc_id, None) for r in out.collect()]
    clean = kept["toxicity"]
    assert not [i for i, _ in clean if i is not None and i >= 200] and len([i for i, _ in clean if i is not None and 100 <= i < 200]) == 20
    texts = [t or "" for _, t in kept["exact_dedup"]]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in clean})  # null and empty texts are equal
    ids = {i for i, _ in kept["minhash_dedup"]}
    assert (7 in ids) != (8 in ids) and 3 in ids and {100 + i for i in range(20)} <= ids
    assert {i for i, _ in kept["mix_sources"]} <= ids and {i for i, _ in kept["byte_bpe"]} == {i for i, _ in kept["mix_sources"]}


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA).withColumns({c: F.lit(1) for c in CLASH})
    for name, _, out in stages(spark, docs, tmp_path, []):
        assert out.count() == 0 and "doc_id" in out.columns
