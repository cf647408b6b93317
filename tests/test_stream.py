"""G1: two manifests dropped into a folder, processed by the stream, restart
from the checkpoint, same catalog as a batch run."""

import csv
import os
import time

from docfetch import schemas as S
from docfetch.plans.job import read_catalog
from docfetch.streaming.ingest import ingest_stream

HEADERS = list(S.MANIFEST_COLUMN_MAP)


def _drop(path, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(HEADERS)
        w.writerows(rows)


def test_ingest_stream_two_files_and_restart(spark, tmp_path):
    site = tmp_path / "site"
    site.mkdir()
    (site / "a.pdf").write_bytes(b"%PDF-1.4 a")
    (site / "b.pdf").write_bytes(b"%PDF-1.4 b")
    drop, dest, state, ck = (tmp_path / n for n in ("drop", "pdf-files", "state", "ck"))
    drop.mkdir()
    dest.mkdir()
    u = f"file://{site}"
    _drop(drop / "1.csv", [["K1", "first", "2019", "", "", "", "", "", f"{u}/a.pdf", ""],
                           ["K2", "two", "2019", "", "", "", "", "", f"{u}/zz.pdf", ""]])
    _drop(drop / "2.csv", [["K1", "changed title", "2019", "", "", "", "", "", f"{u}/a.pdf", ""],
                           ["K3", "three", "2020", "", "", "", "", "", f"{u}/b.pdf", ""],
                           ["", "no key", "2020", "", "", "", "", "", f"{u}/b.pdf", ""]])
    t = time.time()
    os.utime(drop / "1.csv", (t - 20, t - 20))   # files are taken in arrival (modification) order
    os.utime(drop / "2.csv", (t - 10, t - 10))
    q = ingest_stream(spark, str(drop), str(state), str(dest), checkpoint=str(ck), now="2024-06-01 00:00:00")
    q.awaitTermination()
    cat = {r.brnumber: r for r in read_catalog(spark, str(state)).collect()}
    assert set(cat) == {"K1", "K2", "K3"}
    assert cat["K1"].title == "changed title"            # D1: later file updates the key
    assert cat["K1"].download_status == "TRUE"
    assert cat["K2"].download_status == "FALSE"
    assert (dest / "b.pdf").exists()
    rej = spark.read.parquet(str(state / "rejected")).collect()
    assert [r.title for r in rej] == ["no key"] and rej[0].errors == ["brnumber cannot be null"]
    n_attempts = spark.read.parquet(str(state / "attempts")).count()

    # restart from the same checkpoint: nothing new, nothing re-run
    q = ingest_stream(spark, str(drop), str(state), str(dest), checkpoint=str(ck), now="2024-06-02 00:00:00")
    q.awaitTermination()
    assert spark.read.parquet(str(state / "attempts")).count() == n_attempts

    # a CSV and a workbook arrive later
    _drop(drop / "3.csv", [["K4", "four", "2021", "", "", "", "", "", f"{u}/a.pdf", ""]])
    from test_io import _xlsx
    _xlsx(drop / "4.xlsx", [[["BRnum", "Title", "Pdf_URL"], ["K5", "five", f"{u}/b.pdf"]]])
    os.utime(drop / "4.xlsx", (t + 10, t + 10))
    with open(drop / "5.csv", "w") as f:                   # Q12: no BRnum column - rejected, stream goes on
        f.write("Title,pdf_url\nx,http://h/x.pdf\n")
    os.utime(drop / "5.csv", (t + 20, t + 20))
    _xlsx(drop / "6.xlsx", [[["Title", "Pdf_URL"], ["no key column", f"{u}/b.pdf"]]])
    os.utime(drop / "6.xlsx", (t + 30, t + 30))
    (drop / "7.xlsx").write_bytes(b"not a zip at all")          # unreadable: rejected, stream goes on
    os.utime(drop / "7.xlsx", (t + 40, t + 40))
    _drop(drop / "8.csv", [["K8", "eight", "2021", "", "", "", "", "", f"{u}/a.pdf", ""]])
    os.utime(drop / "8.csv", (t + 50, t + 50))
    q = ingest_stream(spark, str(drop), str(state), str(dest), checkpoint=str(ck), now="2024-06-03 00:00:00")
    q.awaitTermination()
    cat = {r.brnumber: r for r in read_catalog(spark, str(state)).collect()}
    assert set(cat) == {"K1", "K2", "K3", "K4", "K5", "K8"}
    assert cat["K4"].download_message == S.MSG_EXISTS_IN_FOLDER
    assert cat["K5"].title == "five" and cat["K5"].region == "" and cat["K5"].download_status == "TRUE"
    rej = spark.read.parquet(str(state / "rejected"))
    lacking = [r for r in rej.collect() if r.errors and r.errors[0].startswith("manifest lacks")]
    assert sorted(r.title for r in lacking) == ["no key column", "x"]
    broken = [r for r in rej.collect() if r.errors and r.errors[0] == "manifest file could not be read"]
    assert len(broken) == 1 and "BadZipFile" in broken[0].read_error
