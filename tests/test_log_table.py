"""The log table against full versions: what is read, what is written, who wins."""

import glob
import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from docfetch.operators import catalog as CA
from docfetch.sources import log_table as LT
from docfetch.sources import tables as TB
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("id", LongType()), StructField("brnumber", StringType()),
                     StructField("title", StringType()), StructField("note", StringType())])


def _files(root):
    return {f: os.path.getsize(f) for f in glob.glob(f"{root}/data/**/*.parquet", recursive=True)}


def _rows(df):
    return sorted(map(tuple, df.select(*SCHEMA.fieldNames()).collect()), key=str)


def _updates(spark, rows):
    return spark.createDataFrame(rows, "row_no long, brnumber string, title string")


def _catalog(spark, n):
    return spark.createDataFrame([(i + 1, f"K{i:05d}", f"t{i}", f"n{i}") for i in range(n)], SCHEMA)


def test_equals_full_versions(spark, tmp_path):
    """Random upserts, deletes and merges; every version reads as the full table would."""
    rng = random.Random(2)
    root = str(tmp_path / "t")
    LT.create(spark, root, _catalog(spark, 300), range_rows=60)
    assert len(LT.read_commit(spark, root)[1]["ranges"]) == 5
    full, most, seen = _catalog(spark, 300), 300, {}
    for step in range(7):
        kind = ["upsert", "upsert", "delete", "upsert", "merge", "upsert", "merge"][step]
        if kind == "upsert":
            rows = [(i, rng.choice([None, "A0", "K00010x", "Z", *(f"K{rng.randrange(400):05d}",) * 5]), f"u{step}-{i}") for i in range(20)]
            LT.upsert(spark, root, _updates(spark, rows), SCHEMA)
            full = spark.createDataFrame(CA.upsert(full, _updates(spark, rows), max_id=most).collect(), SCHEMA)
            most = max(most, full.agg(F.max("id")).first()[0])
        elif kind == "delete":
            keys = spark.createDataFrame([("K00005",), ("K00005",), ("none",), (None,), ("Z",)], "brnumber string")
            LT.delete(spark, root, keys, SCHEMA)
            full = spark.createDataFrame(CA.delete_rows(full, keys.where("brnumber is not null"), "brnumber").select(*SCHEMA.fieldNames()).collect(), SCHEMA)
        else:
            LT.merge(spark, root, SCHEMA, range_rows=60)
        seen[LT.read_commit(spark, root)[0]] = _rows(full)
        assert _rows(LT.read(spark, root, SCHEMA)) == _rows(full)
    for version, rows in seen.items():                                    # older versions stay readable
        assert _rows(LT.read(spark, root, SCHEMA, version=version)) == rows
    ranges = LT.read_commit(spark, root)[1]["ranges"]
    bounds = sorted(spark.read.parquet(r["path"]).agg(F.min("brnumber"), F.max("brnumber")).first()[:] for r in ranges)
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))           # ranges cover disjoint keys


def test_an_upsert_writes_its_rows_only(spark, tmp_path):
    root = str(tmp_path / "t")
    LT.create(spark, root, _catalog(spark, 2000), range_rows=500)
    before = _files(root)
    LT.upsert(spark, root, _updates(spark, [(i, f"K{i * 100:05d}", "x") for i in range(7)]), SCHEMA)
    after = _files(root)
    assert all(after[f] == size for f, size in before.items())            # no file was rewritten
    new = [f for f in after if f not in before]
    assert sum(spark.read.parquet(f).count() for f in new) == 7
    assert LT.read_commit(spark, root)[1]["deltas"][0]["rows"] == 7


def test_a_merge_rewrites_touched_ranges_only(spark, tmp_path):
    root = str(tmp_path / "t")
    LT.create(spark, root, _catalog(spark, 1000), range_rows=100)
    old = {r["path"] for r in LT.read_commit(spark, root)[1]["ranges"]}
    # two keys of one range, and so many of another that it is cut
    rows = [(0, "K00250", "x"), (1, "K00251x", "y")] + [(i, f"K00700-{i:04d}", "z") for i in range(2, 400)]
    LT.upsert(spark, root, _updates(spark, rows), SCHEMA)
    LT.merge(spark, root, SCHEMA, range_rows=100)
    commit = LT.read_commit(spark, root)[1]
    new = {r["path"] for r in commit["ranges"]}
    assert len(old - new) <= 3 and len(old & new) >= 7 and len(new) > len(old) and not commit["deltas"]
    assert LT.read(spark, root, SCHEMA).count() == 1000 + 399


def test_reads_only_ranges_that_can_hold_the_keys(spark, tmp_path):
    root = str(tmp_path / "t")
    LT.create(spark, root, _catalog(spark, 1000), range_rows=100)
    some = LT.read(spark, root, SCHEMA, low="K00250", high="K00260")
    assert 0 < some.count() <= 220 and some.where("brnumber between 'K00250' and 'K00260'").count() == 11
    commit = LT.read_commit(spark, root)[1]
    assert len(LT._holding(commit["ranges"], "A", "B")) == 0 and len(LT._holding(commit["ranges"], "Z", "Z")) == 1
    assert len(LT._holding(commit["ranges"], None, None)) == 10


def test_small_deltas_do_not_shuffle_the_base(spark, tmp_path):
    """A read joins the base with a broadcast of the deltas' keys: no exchange above its scan."""
    root = str(tmp_path / "t")
    LT.create(spark, root, _catalog(spark, 1000), range_rows=100)
    for n in range(3):
        LT.upsert(spark, root, _updates(spark, [(n, f"K{n:05d}", "x")]), SCHEMA)
    plan = LT.read(spark, root, SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_deltas_are_merged_after_so_many(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in range(5):
        LT.upsert(spark, root, _updates(spark, [(n, f"K{n}", "x")]), SCHEMA, merge_after=4)
    commit = LT.read_commit(spark, root)[1]
    assert len(commit["deltas"]) == 1 and sum(r["rows"] for r in commit["ranges"]) == 4
    assert [r["id"] for r in LT.read(spark, root, SCHEMA).orderBy("brnumber").collect()] == [1, 3, 6, 10, 15]


def test_concurrent_upserts_keep_all(spark, tmp_path):
    """Writers that read one version commit one after the other, with ids of their own."""
    root = str(tmp_path / "t")
    LT.create(spark, root, _catalog(spark, 10))
    run = lambda n: LT.upsert(spark, root, _updates(spark, [(n, f"N{n}", "x"), (n + 10, "K00003", f"by{n}")]), SCHEMA, note=f"t{n}")
    threads = [threading.Thread(target=run, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    rows = {r["brnumber"]: r for r in LT.read(spark, root, SCHEMA).collect()}
    assert len(rows) == 14 and len({r["id"] for r in rows.values()}) == 14 and rows["K00003"]["id"] == 4
    assert all(TB.is_committed(spark, root, f"t{n}") for n in range(4))


def test_a_merge_keeps_what_others_commit_meanwhile(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    LT.create(spark, root, _catalog(spark, 10))
    LT.upsert(spark, root, _updates(spark, [(0, "K00001", "first")]), SCHEMA)
    real = LT._write_ranges

    def write(*args):
        real(*args)
        monkeypatch.setattr(LT, "_write_ranges", real)
        LT.upsert(spark, root, _updates(spark, [(0, "K00001", "second"), (1, "L", "new")]), SCHEMA)

    monkeypatch.setattr(LT, "_write_ranges", write)
    LT.merge(spark, root, SCHEMA)
    commit = LT.read_commit(spark, root)[1]
    assert len(commit["deltas"]) == 1
    got = {r["brnumber"]: r["title"] for r in LT.read(spark, root, SCHEMA).collect()}
    assert got["K00001"] == "second" and got["L"] == "new" and len(got) == 11


def test_begins_from_a_full_version(spark, tmp_path):
    root = str(tmp_path / "t")
    TB.save_table(_catalog(spark, 20), root)
    LT.upsert(spark, root, _updates(spark, [(0, "K00003", "x"), (1, "new", "y")]), SCHEMA)
    got = {r["brnumber"]: (r["id"], r["title"]) for r in LT.read(spark, root, SCHEMA).collect()}
    assert len(got) == 21 and got["K00003"] == (4, "x") and got["new"] == (22, "y")
    LT.merge(spark, root, SCHEMA)
    assert LT.read(spark, root, SCHEMA).count() == 21


def test_empty_and_missing(spark, tmp_path):
    root = str(tmp_path / "t")
    assert LT.read(spark, root, SCHEMA).count() == 0 and LT.merge(spark, root, SCHEMA) == 0
    LT.create(spark, root, _catalog(spark, 0))
    LT.upsert(spark, root, _updates(spark, [(0, None, "x")]), SCHEMA)
    assert LT.read(spark, root, SCHEMA).count() == 0 and LT.read_commit(spark, root)[0] == 2
    with pytest.raises(TB.VersionConflict):
        LT.create(spark, root, _catalog(spark, 1))
    assert json.loads(TB.read_text_file(spark, f"{root}/versions/{2:012d}.json"))["deltas"] == []
