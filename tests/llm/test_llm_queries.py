"""The registered queries against their SQL, and the pipeline stage by stage against plain versions."""

import os
import sys

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from docfetch.llm import queries

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
SF = "/root/testdata/sf0.001"


def test_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    expected = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF).select(*expected.columns)
    assert sorted(map(tuple, got.collect())) == sorted(expected.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    columns, kept, rows = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
        kept[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        if name != "encoding":
            assert docs.columns == columns
            rows[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    clean = {i for i, label in labels.items() if label == (1, 0)}
    assert len(clean & set(kept["quality"])) >= 0.97 * len(clean)
    groups = {}
    for i, _, c in brute.jaccard(rows["quality"], 5, 80):
        groups.setdefault(c, i)
    assert kept["near_duplicates"] == sorted(groups)
    leaks = {r[0] for r in brute.decontamination(rows["near_duplicates"], items) if r[5]}
    assert kept["decontamination"] == sorted(set(groups) - leaks)
    assert kept["private_data"] == kept["encoding"] == kept["decontamination"]
    assert sum(sum(r[1:5]) for r in brute.pii(rows["decontamination"])) > 0
    assert sum(sum(r[1:5]) for r in brute.pii(rows["private_data"])) == 0
    decoded = {r["doc_id"]: r["decoded_sha256"] for r in docs.collect()}
    assert decoded == {i: brute.sha(t.encode()) for i, t in rows["private_data"]}


def test_pipeline_odd_rows(spark):
    """Nulls, empty texts and repeated rows go through every stage. (What the classifier
    makes of so few documents is left open.)"""
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(60)) + " "
    rows = [(None, None), (None, text), (1, None), (2, ""), (3, text + "x"), (3, text + "x"), (4, text + "y mail a.b@c.de")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars int")
    assert corpus_pipeline.quality(spark, docs, SF).count() <= len(rows)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
    got = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert (1, None) in got and (2, "") in got
    assert len([t for _, t in got if t]) == 1                       # one of the near copies
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(got) and last.where(F.col("n_tokens") == 0).count() == len([t for _, t in got if not t])


def test_pipeline_unrelated_groups(spark):
    """Groups without an id, and groups under one id, each keep a text of their own."""
    import corpus_pipeline

    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (5, text("c")), (5, text("d")), (6, text("c") + " end"),
            (7, text("d") + " end"), (None, text("d") + " last"), (None, text("a")), (None, text("b") + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars int").repartition(4)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert len(got) == 4
    assert {r for r in got if r[0] is not None} == {(5, text("c")), (5, text("d"))}
    assert {t[0] for i, t in got if i is None} == {"a", "b"}
