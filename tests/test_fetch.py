"""C4/C6 and the end-to-end run on file:// URLs (no network)."""

import os

import pytest
from pyspark.sql import functions as F

from docfetch import schemas as S
from docfetch.operators import fetch as FE
from docfetch.plans.run import run_manifest


@pytest.fixture()
def site(tmp_path):
    src = tmp_path / "site"
    src.mkdir()
    (src / "ok.pdf").write_bytes(b"%PDF-1.4 ok")
    (src / "UP.PDF").write_bytes(b"%PDF-1.4 up")
    (src / "noext").write_bytes(b"%PDF-1.4 noext")
    (src / "html.pdf").write_bytes(b"<html>nope</html>")
    dest = tmp_path / "pdf-files"
    dest.mkdir()
    return src, dest


def _manifest(spark, rows):
    cols = ["row_no", "brnumber", "title", "publication_year", "organization_name", "organization_type",
            "organization_sector", "country", "region", "pdf_url", "pdf_backup_url"]
    full = [(i, br, f"t{i}", "2020", "o", "Private", "s", "c", "r", u, b) for i, (br, u, b) in enumerate(rows)]
    return spark.createDataFrame(full, ", ".join(f"{c} {'long' if c == 'row_no' else 'string'}" for c in cols))


def _empty_catalog(spark):
    return spark.createDataFrame([], S.CATALOG_SCHEMA)


def test_fetch_documents_outcomes(spark, site):
    src, dest = site
    rows = spark.createDataFrame(
        [(0, f"file://{src}/ok.pdf", "ok.pdf"), (1, f"file://{src}/html.pdf", "html.pdf"),
         (2, f"file://{src}/missing.pdf", "missing.pdf"), (3, None, "x.pdf")],
        "row_no long, pdf_url string, stored_name string")
    out = {r.row_no: r for r in FE.fetch_documents(rows, dest=str(dest)).collect()}
    assert out[0].outcome == "successful" and out[0].message == S.MSG_DOWNLOADED
    assert (dest / "ok.pdf").read_bytes() == b"%PDF-1.4 ok"
    assert out[1].outcome == "failed" and out[1].message == S.MSG_NOT_PDF
    assert out[2].outcome == "failed" and "No such file" in out[2].message
    assert out[3].outcome == "failed" and out[3].message == S.MSG_MISSING_URL     # Q14
    assert not [f for f in os.listdir(dest) if f.endswith(".part")]


def test_run_manifest_end_to_end(spark, site):
    src, dest = site
    u = f"file://{src}"
    m = _manifest(spark, [
        ("BR0", f"{u}/ok.pdf", None),                 # fetched
        ("BR1", f"{u}/UP.PDF", None),                 # Q5: stored as UP.PDF.pdf
        ("BR2", f"{u}/noext", None),                  # stored as noext.pdf
        ("BR3", f"{u}/html.pdf", f"{u}/ok.pdf"),      # C6: backup rescues (name already stored -> ok)
        ("BR4", None, None),                          # Q14: missing url
        ("BR5", f"{u}/ok.pdf", None),                 # Q7: same name as BR0 -> already downloaded
    ])
    files = spark.createDataFrame([], "file_name string")
    res = run_manifest(m, files, _empty_catalog(spark), str(dest), "2024-06-01 00:00:00")
    up = {r.brnumber: r for r in res.updates.collect()}
    assert up["BR0"].download_status == "TRUE" and up["BR0"].file_name == "ok.pdf"
    assert up["BR1"].file_name == "UP.PDF.pdf" and (dest / "UP.PDF.pdf").exists()
    assert up["BR2"].file_name == "noext.pdf"
    assert up["BR3"].download_status == "TRUE"
    assert up["BR4"].download_status == "FALSE" and up["BR4"].file_name == "" and up["BR4"].file_folder == ""
    assert up["BR5"].download_status == "TRUE" and up["BR5"].download_message == S.MSG_EXISTS_IN_FOLDER
    counts = res.counts.first()   # Q4: reference counters count the first attempt only
    assert (counts.successful, counts.already_downloaded, counts.failed, counts.processed_rows) == (3, 1, 2, 6)
    totals = res.totals.first()
    assert totals.successful + totals.already_downloaded + totals.failed == totals.processed_rows == 6
    assert res.catalog.count() == 6 and res.catalog.select("brnumber").distinct().count() == 6

    # E7 over the real folder listing: stored TRUE rows are deliverable, the failed one is not
    from docfetch.operators.browse import resolve_delivery
    from docfetch.sources.tables import list_stored_files as _ls
    deliver = {r.brnumber: r for r in resolve_delivery(res.catalog, _ls(spark, str(dest))).collect()}
    assert deliver["BR0"].deliver_path == f"{dest}/ok.pdf" and deliver["BR0"].reason is None
    assert deliver["BR1"].deliver_path == f"{dest}/UP.PDF.pdf"
    assert deliver["BR4"].deliver_path is None and deliver["BR4"].reason == S.MSG_PDF_NOT_FOUND

    # re-run with the folder listing and the new catalog: nothing is fetched again
    from docfetch.sources.tables import list_stored_files
    cat = spark.createDataFrame(res.catalog.collect(), S.CATALOG_SCHEMA)
    res2 = run_manifest(m, list_stored_files(spark, str(dest)).select("file_name"), cat, str(dest),
                        "2024-06-02 00:00:00")
    dec = {r.brnumber: r.decision for r in res2.plan.join(m.select("row_no"), "row_no").collect()}
    assert dec["BR0"] == "already_downloaded" and dec["BR3"] == "already_downloaded"
    # Q6: UP.PDF was stored as UP.PDF.pdf, so the raw name is not in the folder; the catalog catches it
    plan = {r.brnumber: r for r in res2.plan.collect()}
    assert plan["BR1"].in_folder is False and plan["BR1"].in_catalog is True
    assert plan["BR1"].stored_name == "UP.PDF.pdf"   # Q8: keeps the stored name
    assert res2.attempts.where(F.col("outcome") == "successful").count() == 0


def test_upsert_is_idempotent(spark, site):
    from docfetch.operators.catalog import upsert
    src, dest = site
    m = _manifest(spark, [("BR0", f"file://{src}/ok.pdf", None)])
    res = run_manifest(m, spark.createDataFrame([], "file_name string"), _empty_catalog(spark), str(dest),
                       "2024-06-01 00:00:00")
    once = spark.createDataFrame(res.catalog.collect(), S.CATALOG_SCHEMA)
    twice = upsert(once, res.updates)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_missing_and_empty_names_never_match_the_folder(spark):
    from docfetch.plans.fetch_plan import mark_existing_files
    df = spark.createDataFrame([(i, None if i % 3 == 0 else ("" if i % 3 == 1 else f"f{i}.pdf"))
                                for i in range(30)], "row_no long, file_name string")
    files = spark.createDataFrame([("",), ("f2.pdf",), ("f5.pdf",)], "file_name string")
    got = {r.row_no: r.in_folder for r in mark_existing_files(df, files).collect()}
    assert got == {i: i in (2, 5) for i in range(30)}


def test_host_slots_bound_tasks_per_host(spark, site):
    src, _ = site
    rows = spark.createDataFrame([(i, f"file://{src}/ok.pdf" if i % 2 else f"http://one.example/{i}.pdf", f"{i}.pdf")
                                  for i in range(40)], "row_no long, pdf_url string, stored_name string")
    out = FE.fetch_documents(rows, host_slots=2, num_partitions=8, timeout=0.01)
    from pyspark.sql import functions as F
    per_host = (out.withColumn("pid", F.spark_partition_id())
                .withColumn("host", F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
                .groupBy("host").agg(F.countDistinct("pid").alias("tasks")).collect())
    assert all(r.tasks <= 2 for r in per_host) and out.count() == 40
    assert out.where("url like 'file:%'").where("outcome = 'successful'").count() == 20


def test_empty_backup_url_is_no_second_attempt(spark, site):
    src, dest = site
    m = _manifest(spark, [("K1", f"file://{src}/missing.pdf", ""), ("K2", f"file://{src}/missing.pdf", None)])
    res = run_manifest(m, spark.createDataFrame([], "file_name string"), _empty_catalog(spark), str(dest),
                       "2024-06-01 00:00:00")
    assert res.attempts.where("attempt = 2").count() == 0
    msgs = {r.brnumber: r.download_message for r in res.updates.collect()}
    assert all("No such file" in m for m in msgs.values())


def test_rows_of_one_url_share_its_download(spark, site):
    src, dest = site
    u = f"file://{src}"
    m = _manifest(spark, [(f"N{i}", f"{u}/noext", None) for i in range(20)]                    # stored as noext.pdf
                  + [(f"B{i}", f"{u}/missing", f"{u}/UP.PDF") for i in range(20)]              # by the backup URL
                  + [(f"M{i}", f"{u}/missing", f"{u}/gone") for i in range(5)])
    fetched = []

    def persist(df):
        out = FE.persist_attempts(df)
        if "bytes_written" in out.columns:
            fetched.extend(r.url for r in out.collect())
        return out

    res = run_manifest(m, spark.createDataFrame([], "file_name string"), _empty_catalog(spark), str(dest),
                       "2024-06-01 00:00:00", persist=persist)
    assert fetched.count(f"{u}/noext") == 1 and fetched.count(f"{u}/UP.PDF") == 1
    assert fetched.count(f"{u}/missing") == 25 and fetched.count(f"{u}/gone") == 5   # a failure is not shared
    up = {r.brnumber: r for r in res.updates.collect()}
    assert len(up) == 45
    for key, name in (("N", "noext.pdf"), ("B", "UP.PDF.pdf"), ("M", "")):
        rows = [r for k, r in up.items() if k.startswith(key)]
        assert {r.file_name for r in rows} == {name}
        assert {r.download_message == S.MSG_DOWNLOADED for r in rows} == {key != "M"}
    counts = res.counts.first()
    assert (counts.successful, counts.already_downloaded, counts.failed, counts.processed_rows) == (20, 0, 25, 45)
    assert res.totals.first().successful == 40
    assert (dest / "noext.pdf").read_bytes() == (src / "noext").read_bytes()
