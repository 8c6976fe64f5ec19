"""CSV with line feeds in quotes, cut into splits at any place."""

import csv
import io
import random

import pytest

from sievemark.sources import manifests as R
from sievemark.sources.quoted import read_quoted, records


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def table(seed, n):
    r = random.Random(seed)
    bits = ["a", "é", '"', "\n", ",", " ", "\n\n", "word", '""', "\n,\n"]
    return [[str(i), "".join(r.choice(bits) for _ in range(r.randrange(9))), r.choice(["", "x", "long " * r.randrange(300) + "\nend"])] for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_as_python_reads_it(spark, tmp_path, small_splits, end):
    want = {}
    for k in range(2):
        out = io.StringIO()
        w = csv.writer(out, lineterminator=end)
        w.writerows([["id", "text", "more"], *table(k, 150)])
        (tmp_path / f"f{k}.csv").write_bytes(out.getvalue().encode())
        want |= {(f"f{k}.csv", r[0]): r for r in csv.DictReader(io.StringIO(out.getvalue(), newline="")).reader if r[0] != "id"}
    df = read_quoted(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = {(r._file.rsplit("/", 1)[1], r.id): [r.id, r.text or "", r.more or ""] for r in df.collect()}
    assert got == {k: [v[0], v[1], v[2]] for k, v in want.items()}
    # Places: the first line of each record in its file.
    for r in records(spark, str(tmp_path / "f0.csv")).collect():
        lines = (tmp_path / "f0.csv").read_bytes().decode().split("\n")
        assert lines[r.line - 1].startswith(r.record.split("\n")[0].rstrip("\r"))


def test_rejects_carry_their_place(spark, tmp_path):
    head = ",".join(R.REQUIRED)
    row = lambda i, label, role: f'{i},"a\nb.png",{label},d,s,g,{role},{"0" * 64},{"0" * 16}'
    (tmp_path / "m.csv").write_text("\n".join([head, row(1, 1, "train"), row(2, 7, "train"), "", row(3, 0, "none"), row(4, 0, "test")]))
    rows, rejects = R.read_manifest(spark, str(tmp_path / "m.csv"), strict=False)
    assert sorted(r.sample_id for r in rows.collect()) == ["1", "4"] and "_line" not in rows.columns
    assert sorted((r.sample_id, r._problem, r._line) for r in rejects.collect()) == [("2", "label", 4), ("3", "role", 7)]
    with pytest.raises(ValueError, match="2 bad rows"):
        R.read_manifest(spark, str(tmp_path / "m.csv"))


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n1,2\n")
    with pytest.raises(ValueError, match="headers differ"):
        read_quoted(spark, str(tmp_path))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "e.csv").write_text("\n\n")
    with pytest.raises(ValueError, match="no header"):
        read_quoted(spark, str(tmp_path / "c"))
