"""Quoted newlines cut into byte ranges: equal to Spark's reader of whole files."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from docfetch.sources import csv_lines as CL
from docfetch.sources import manifest as M


@pytest.fixture
def splits(spark):
    """Ranges of so many bytes, however small the file."""
    def of(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _cell(rng):
    return rng.choice(["", "a", "two\nlines", 'a "quote"', "x,y", '"', '""', "\n", '\n"\n,"', "é漢", "a\r\nb", "long " * 30,
                       ",\n" * 9, " lead", "1"])


def _text(rng, n, newline="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=newline, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    w.writerow(["k", "a", "b"])
    w.writerows([f"K{i}", _cell(rng), _cell(rng)] for i in range(n))
    return out.getvalue()


def _whole_file(spark, path):
    """Spark's own reader, one task a file, in file order."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return [tuple(r) for r in raw.coalesce(1).collect()]


@pytest.mark.parametrize("seed,size", [(1, 40), (2, 300), (3, 64), (4, 2000)])
def test_equals_the_whole_file_reader(spark, tmp_path, splits, seed, size):
    rng = random.Random(seed)
    path = tmp_path / "list.csv"
    path.write_bytes(_text(rng, 300, rng.choice(["\n", "\r\n"])).encode())
    expected = _whole_file(spark, str(path))
    splits(size)
    got = M.read_manifest_csv(spark, str(path))
    assert CL.read_rows(spark, str(path)).select("row").distinct().count() == 301
    rows = sorted(got.collect(), key=lambda r: r["row_no"])
    assert [r["row_no"] for r in rows] == list(range(300))
    assert [(r["k"], r["a"], r["b"]) for r in rows] == expected and len({r["source_file"] for r in rows}) == 1


def test_many_ranges(spark, tmp_path, splits):
    """A cell over many ranges, a range of no row, stray quotes, empty lines, no last newline."""
    path = tmp_path / "list.csv"
    path.write_text('﻿k,a,b\n\n1,"' + "line\n" * 200 + '",x\n2,5" pipe,"y"\n\n\n3,"un""closed ""\n",z\n4,"a"b,c\n5,p')
    splits(50)
    text = spark.read.option("lineSep", "\n").text(str(path))
    assert text.rdd.getNumPartitions() > 15
    got = {r["row_no"]: (r["k"], r["a"], r["b"]) for r in M.read_manifest_csv(spark, str(path)).collect()}
    assert got == {0: ("1", "line\n" * 200, "x"), 1: ("2", '5" pipe', "y"), 2: ("3", 'un"closed "\n', "z"),
                   3: ("4", '"a"b', "c"), 4: ("5", "p", None)}


def test_several_files(spark, tmp_path, splits):
    rng = random.Random(5)
    expected = []
    for n, name in enumerate(["a", "b", "c"]):
        (tmp_path / f"{name}.csv").write_bytes(_text(rng, 50 * n + 1).encode())
        expected += [(f"{name}.csv", i, *r) for i, r in enumerate(_whole_file(spark, str(tmp_path / f"{name}.csv")))]
    splits(97)
    got = M.read_manifest_csv(spark, str(tmp_path)).withColumn("f", F.substring_index("source_file", "/", -1))
    assert sorted(map(str, ((r["f"], r["row_no"], r["k"], r["a"], r["b"]) for r in got.collect()))) == sorted(map(str, expected))


def test_only_rows_of_several_lines_are_shuffled(spark, tmp_path, splits):
    path = tmp_path / "list.csv"
    path.write_text("k,a\n" + "".join(f"{i},x\n" for i in range(500)) + '500,"p\nq"\n501,"r\ns"\n')
    splits(256)
    rows = CL.read_rows(spark, str(path))
    assert rows.count() == 503
    parts = [r["text"] for r in rows.where(F.col("text").contains("\n")).collect()]
    assert sorted(parts) == ['500,"p\nq"', '501,"r\ns"']


@pytest.mark.parametrize("line,out,inside", [
    ("", False, True), ("a,b", False, True), ('a,"b', True, False), ('"', True, False), ('""', False, True),
    ('a,"b"', False, False), ('a","b', True, True), ('x"y', False, False), ('a""b', False, True), ('"a""', True, False)])
def test_state_after(line, out, inside):
    assert (CL.state_after(line, False), CL.state_after(line, True)) == (out, inside)
