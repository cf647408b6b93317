"""Pages from the index against the sorted table: all pages, any order, few files read."""

import random

import pytest
from pyspark.sql import functions as F

from docfetch.operators import browse as BR
from docfetch.operators import page_index as PI

SCHEMA = "id long, brnumber string, title string, year string"


def _catalog(spark, n):
    rng = random.Random(1)
    rows = [(i or None, f"K{i:05d}", rng.choice([None, "a", "B", "c", f"t{i % 7}"]), rng.choice(["2019", "2020"])) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("sort_col,order,size", [("title", "asc", 37), ("title", "desc", 100), (None, "asc", 64), ("year", "x", 501)])
def test_every_page(spark, tmp_path, sort_col, order, size):
    df = _catalog(spark, 1000)
    index = PI.build(df, str(tmp_path / "i"), sort_col, order, ranges=9)
    assert index["total"] == 999 and sum(n for _, n in index["ranges"]) == 1000      # one id is null
    expected = [tuple(r) for r in BR.sort_by(df, sort_col, order).collect()]
    got = []
    for page_no in range(1, 1000 // size + 2):
        rows = PI.read_page(spark, index, df.schema, page_no, size).collect()
        assert all(r["total_pdfs"] == 999 for r in rows)
        got += [tuple(r)[:4] for r in rows]
    assert got == expected
    assert PI.read_page(spark, index, df.schema, 10 ** 6, size).count() == 0
    with pytest.raises(BR.QueryError):
        PI.read_page(spark, index, df.schema, 0, size)


def test_a_deep_page_reads_its_ranges_only(spark, tmp_path):
    df = _catalog(spark, 20_000)
    index = PI.build(df, str(tmp_path / "i"), "title", ranges=20)
    page = PI.read_page(spark, index, df.schema, 1500, 10)
    assert page.count() == 10 and len(page.inputFiles()) <= 2
    assert "PushedFilters" in page._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[:4] for r in page.collect()] == [tuple(r) for r in BR.page(BR.sort_by(df, "title"), 1500, 10).collect()]


def test_one_index_per_query_and_version(spark, tmp_path):
    df, root = _catalog(spark, 300), str(tmp_path / "pages")
    ask = lambda version, page_no, f='{"year": "2019"}': [tuple(r) for r in PI.query_catalog_indexed(
        df, version, root, f, "title", "desc", page_no, 20, ranges=4).collect()]
    for page_no in (1, 3):
        assert ask(1, page_no) == [tuple(r) for r in BR.query_catalog(df, '{"year": "2019"}', "title", "desc", page_no, 20).collect()]
    assert len(list((tmp_path / "pages").iterdir())) == 1
    ask(2, 1)
    ask(2, 1, None)
    assert len(list((tmp_path / "pages").iterdir())) == 3
    empty = PI.query_catalog_indexed(df.where(F.lit(False)), 9, root, None, "title")
    assert empty.count() == 0
