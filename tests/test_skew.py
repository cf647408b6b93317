"""A key holding a third of all rows must not become one task.

AQE is switched off here, so the partitioning seen is the plan's own (nothing
re-balances it at runtime)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docfetch.operators.keys import flag_extreme_per_key, keep_extreme_per_key
from docfetch.operators.runs import running_counts

N = 3000


@pytest.fixture()
def no_aqe(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _sizes(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_first_per_key_spreads_a_hot_key(no_aqe):
    spark = no_aqe
    rows = [(i, "hot" if i % 3 == 0 else f"k{i}") for i in range(N)]
    df = spark.createDataFrame(rows, "row_no long, k string").repartition(8)
    out = flag_extreme_per_key(df, ["k"], "row_no", "first")
    sizes = _sizes(out)
    assert max(sizes) < 2 * N / len(sizes)            # no partition holds the hot key's third
    assert out.where("first").count() == N - N // 3 + 1
    kept = keep_extreme_per_key(df, ["k"], "row_no", last=True)
    assert kept.where("k = 'hot'").first().row_no == N - 3


def test_running_counts_spread_a_hot_run(no_aqe):
    spark = no_aqe
    base = dt.datetime(2024, 1, 1)
    # a third of the rows: one run, one time stamp
    rows = [(0, i, base, "successful") if i % 3 == 0 else (i, i, base + dt.timedelta(seconds=7 * i), "successful")
            for i in range(N)]
    df = spark.createDataFrame(rows, "run_id long, seq long, finished_at timestamp_ntz, outcome string")
    out = running_counts(df, slices=8)
    sizes = _sizes(out)
    assert max(sizes) < 2 * N / len(sizes)
    hot = out.where("run_id = 0").agg(F.max("processed_rows")).first()[0]
    assert hot == N // 3


def test_hot_file_name_is_split_by_aqe(spark):
    """C1 with a name a third of the rows share: AQE must be able to split it
    (both joins read straight from a shuffle)."""
    from docfetch.plans.fetch_plan import mark_existing_files
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 30000
        df = spark.range(n).select(
            F.col("id").alias("row_no"),
            F.when(F.col("id") % 3 == 0, F.lit("shared.pdf"))
            .otherwise(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".pdf"))).alias("file_name"))
        files = spark.range(0, n, 2).select(F.concat(F.lit("f"), F.col("id").cast("string"),
                                                     F.lit(".pdf")).alias("file_name")) \
            .union(spark.createDataFrame([("shared.pdf",)], "file_name string"))
        out = mark_existing_files(df, files)
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert "skew=true" in plan
    present = {r.row_no for r in rows if r.in_folder}
    assert len(rows) == n and present == {i for i in range(n) if i % 3 == 0 or i % 2 == 0}


def test_presence_of_unique_and_repeated_keys(spark):
    """Both forms multiply no row, and no job runs while the plan is built."""
    from docfetch.operators.keys import presence_flag
    df = spark.range(1000).select((F.col("id") % 7).cast("string").alias("k"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    repeated = spark.createDataFrame([("1",), ("1",), ("3",)], "k string")
    before = len(jobs())
    out = presence_flag(df, repeated, ["k"], "hit")
    once = presence_flag(df, repeated.distinct(), ["k"], "hit", unique=True)
    assert len(jobs()) == before
    for x in (out, once):
        assert x.count() == 1000 and x.where("hit").count() == sum(1 for i in range(1000) if i % 7 in (1, 3))
