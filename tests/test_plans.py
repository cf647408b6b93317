"""Plan-shape checks: pushdown, no needless shuffles, single evaluation."""

from pyspark.sql import functions as F

from docfetch.fixtures import Fixtures
from docfetch.operators import browse as B
from docfetch.operators import catalog as CA
from docfetch.operators import prepare as P
from docfetch.operators.keys import keep_extreme_per_key


def _plan(df) -> str:
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _stored_catalog(spark, tmp_path):
    path = str(tmp_path / "catalog")
    Fixtures(spark, "/root/testdata/sf0.001").catalog_v().write.parquet(path)
    return spark.read.parquet(path)


def test_filter_spec_reaches_parquet_scan(spark, tmp_path):
    cat = _stored_catalog(spark, tmp_path)
    plan = _plan(B.filter_equals(cat, '{"download_status": "TRUE", "region": "EUROPE"}'))
    assert "EqualTo(download_status,TRUE)" in plan and "EqualTo(region,EUROPE)" in plan, plan


def test_projection_prunes_scan_columns(spark, tmp_path):
    cat = _stored_catalog(spark, tmp_path)
    plan = _plan(B.public_view(cat, table=True).select("brnumber", "title"))
    assert "ReadSchema: struct<brnumber:string,title:string>" in plan


def test_row_level_operators_do_not_shuffle(spark):
    m = Fixtures(spark, "/root/testdata/sf0.001").manifest_v()
    for df in (P.derive_file_name(m), P.slice_rows(m, 5, 10), P.explode_candidates(m),
               P.require_pdf_suffix(P.derive_file_name(m))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition" not in plan and "Aggregate" not in plan and "Window" not in plan


def test_keep_one_per_key_reads_input_once(spark, tmp_path):
    cat = _stored_catalog(spark, tmp_path)
    plan = _plan(keep_extreme_per_key(cat, ["region"], "id", last=True))
    import re
    assert len(re.findall(r"^\(\d+\) Scan parquet", plan, flags=re.M)) == 1, plan


def test_max_id_reads_only_the_id_column(spark, tmp_path):
    cat = _stored_catalog(spark, tmp_path)
    plan = _plan(cat.agg(F.max("id")))
    assert "ReadSchema: struct<id:bigint>" in plan


def test_upsert_broadcasts_only_the_one_row_maximum(spark, tmp_path):
    cat = _stored_catalog(spark, tmp_path)
    upd = cat.select("id", "brnumber", F.lit("x").alias("title")).withColumnRenamed("id", "row_no")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(CA.upsert(cat, upd))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    import re
    assert len(re.findall(r"^\(\d+\) BroadcastExchange", plan, flags=re.M)) <= 1, plan


def test_case_insensitive_collation_on_request(spark):
    df = spark.createDataFrame([(1, "K1", "Europe"), (2, "K2", "EUROPE"), (3, "K3", "asia")],
                               "id long, brnumber string, region string")
    assert B.filter_equals(df, '{"region": "europe"}').count() == 0
    assert B.filter_equals(df, '{"region": "europe"}', collation="UTF8_LCASE").count() == 2
    order = [r.brnumber for r in B.sort_by(df, "region", "asc", collation="UTF8_LCASE").collect()]
    assert order[0] == "K3"


def test_filter_spec_errors():
    import pytest
    with pytest.raises(B.QueryError, match="Invalid JSON"):
        B.parse_filters("{bad")
    with pytest.raises(B.QueryError, match="key cannot be None"):
        B.parse_filters('{"null": "x"}')
    with pytest.raises(B.QueryError, match="Filter value for region cannot be None"):
        B.parse_filters('{"region": null}')
    assert B.clean_filters({"region": "", "country": "NO"}) == {"country": "NO"}


def test_page_number_must_be_positive(spark):
    import pytest
    with pytest.raises(B.QueryError, match="at least 1"):
        B.page(spark.range(3), 0, 10)


def test_delivery_modes(spark):
    import pytest
    cat = spark.createDataFrame([("K1", "f", "a.pdf", "TRUE", "http://p", None)],
                                "brnumber string, file_folder string, file_name string, download_status string, "
                                "pdf_url string, pdf_backup_url string")
    files = spark.createDataFrame([("f", "a.pdf")], "file_folder string, file_name string")
    assert B.resolve_delivery(cat, files, "local").first().local_uri == "file://f/a.pdf"
    assert B.resolve_delivery(cat, files, "link").columns == ["brnumber", "pdf_url", "pdf_backup_url"]
    assert B.resolve_delivery(cat, files, "download").first().deliver_path == "f/a.pdf"
    with pytest.raises(B.QueryError, match="Invalid response_type"):
        B.resolve_delivery(cat, files, "zip")


def test_register_manifests_with_and_without_overwrite(spark):
    from docfetch.operators.prepare import register_manifests
    registry = spark.createDataFrame([("a.xlsx", "old")], "file_name string, note string")
    new = spark.createDataFrame([(1, "a.xlsx", "new1"), (2, "b.xls", "b"), (3, "a.xlsx", "new2"),
                                 (4, "c.csv", "c")], "seq long, file_name string, note string")
    reg, decided = register_manifests(new, registry, overwrite=False)
    d = {r.seq: (r.decision, r.message) for r in decided.collect()}
    assert d[1] == ("refused", "File a.xlsx already exists.") and d[2] == ("stored", None)
    assert d[4] == ("refused", "Invalid file type. Only Excel files are allowed.")
    assert sorted((r.file_name, r.note) for r in reg.collect()) == [("a.xlsx", "old"), ("b.xls", "b")]
    reg, decided = register_manifests(new, registry, overwrite=True)
    d = {r.seq: r.decision for r in decided.collect()}
    assert d == {1: "superseded", 2: "stored", 3: "stored", 4: "refused"}
    assert sorted((r.file_name, r.note) for r in reg.collect()) == [("a.xlsx", "new2"), ("b.xls", "b")]


def test_no_registered_query_plans_a_cartesian_or_nested_loop_join(spark):
    import __spark_entry__ as E
    offenders = []
    for name, fn in E.queries().items():
        plan = fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            offenders.append(name)
    assert offenders == []


def test_null_names_and_durations(spark):
    from docfetch.functions.columns import duration_text
    from docfetch.operators.prepare import filter_supported, register_manifests
    files = spark.createDataFrame([(1, None), (2, "a.csv")], "seq long, file_name string")
    ok, bad = filter_supported(files)
    assert [r.seq for r in ok.collect()] == [2] and [r.seq for r in bad.collect()] == [1]
    registry = spark.createDataFrame([], "file_name string")
    _, decided = register_manifests(spark.createDataFrame([(1, None)], "seq long, file_name string"), registry)
    assert decided.first().decision == "refused"
    d = spark.createDataFrame([(None,), (3725,)], "s long").select(duration_text("s").alias("t")).collect()
    assert [r.t for r in d] == [None, "1 hours, 2 minutes, 5 seconds"]
