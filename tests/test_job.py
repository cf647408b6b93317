"""The batch run of one manifest file, with its run record (start, refuse, cancel)."""

import csv
import datetime as dt
import os
import threading
import time

import pytest

from docfetch import schemas as S
from docfetch.plans import job as J
from docfetch.plans.job import RunRefused, cancel_runs, read_runs, run_file
from docfetch.plans.job import read_catalog

NOW = dt.datetime(2024, 6, 1, 8, 0, 0)


def test_run_file_end_to_end(spark, tmp_path):
    site = tmp_path / "site"
    site.mkdir()
    (site / "a.pdf").write_bytes(b"%PDF-1.4 a")
    (site / "h.pdf").write_bytes(b"<html>")
    dest, state = tmp_path / "pdf-files", tmp_path / "state"
    dest.mkdir()
    lists = tmp_path / "pdf-urls"
    lists.mkdir()
    u = f"file://{site}"
    with open(lists / "list.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(list(S.MANIFEST_COLUMN_MAP))
        for i, url in enumerate([f"{u}/a.pdf", f"{u}/h.pdf", f"{u}/a.pdf", f"{u}/h.pdf"]):
            w.writerow([f"K{i}", f"t{i}", "2020", "", "", "", "", "", url, ""])

    rec = run_file(spark, str(lists / "list.csv"), str(state), str(dest), start_row=1, num_rows=2, now=NOW)
    assert rec["status"] == "finished" and rec["processed_rows"] == 2
    assert rec["results"] == '{"successful": 1, "already_downloaded": 0, "failed": 1, "processed_rows": 2}'
    cat = {r.brnumber: r for r in read_catalog(spark, str(state)).collect()}
    assert set(cat) == {"K1", "K2"} and cat["K2"].download_status == "TRUE"   # B1 slice: rows 1-2
    runs = {r.task_id: r for r in read_runs(spark, str(state)).collect()}
    assert runs[rec["task_id"]].status == "finished" and runs[rec["task_id"]].start_row == 1

    with pytest.raises(RunRefused, match="Unsupported file format: .txt"):
        run_file(spark, str(lists / "list.txt"), str(state), str(dest))

    # a second run of the whole file: rows already stored are not fetched again
    rec2 = run_file(spark, str(lists / "list.csv"), str(state), str(dest), now=NOW)
    assert rec2["results"] == '{"successful": 0, "already_downloaded": 2, "failed": 2, "processed_rows": 4}'


def test_running_file_is_refused_and_cancel_is_terminal(spark, tmp_path):
    from docfetch.plans.job import write_run
    state = tmp_path / "state"
    rec = {"task_id": "t1", "name": "Download Task", "status": "running", "running_file": "big.xlsx",
           "start_time": NOW, "end_time": None, "processed_rows": 0, "start_row": 0, "num_rows": 0,
           "results": None}
    write_run(spark, str(state), rec, 0)
    with pytest.raises(RunRefused, match="Task already running"):
        run_file(spark, str(tmp_path / "big.xlsx"), str(state), str(tmp_path))
    answers = {r.task_id: r.message for r in cancel_runs(spark, str(state), ["t1", "nope"]).collect()}
    assert answers == {"t1": "Task cancelled", "nope": "No such task"}
    assert {r.task_id: r.status for r in read_runs(spark, str(state)).collect()} == {"t1": "cancelled"}


def test_crashed_run_does_not_block_its_file(spark, tmp_path):
    state = tmp_path / "state"
    with pytest.raises(Exception):
        run_file(spark, str(tmp_path / "absent.csv"), str(state), str(tmp_path / "dest"), now=NOW)
    assert [r.status for r in read_runs(spark, str(state)).collect()] == ["failed"]


def test_unreadable_workbook_is_rejected_not_fatal(spark, tmp_path):
    state, lists = tmp_path / "state", tmp_path / "l"
    lists.mkdir()
    (lists / "bad.xlsx").write_bytes(b"not a zip")
    rec = run_file(spark, str(lists / "bad.xlsx"), str(state), str(tmp_path / "dest"), now=NOW)
    assert rec["status"] == "finished" and rec["processed_rows"] == 0
    rej = spark.read.parquet(str(state / "rejected")).collect()
    assert [r.errors for r in rej] == [["manifest file could not be read"]]


def _hanging_manifest(tmp_path):
    """A row that is done already, one that can be fetched and one whose file never answers."""
    site, dest = tmp_path / "site", tmp_path / "dest"
    site.mkdir()
    dest.mkdir()
    (site / "a.pdf").write_bytes(b"%PDF-1.4 a")
    (dest / "there.pdf").write_bytes(b"%PDF-1.4 b")
    os.mkfifo(site / "never.pdf")
    with open(tmp_path / "list.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(list(S.MANIFEST_COLUMN_MAP))
        for key, url in (("K1", "http://x/there.pdf"), ("K2", f"file://{site}/a.pdf"), ("K3", f"file://{site}/never.pdf")):
            w.writerow([key, key, "2020", "", "", "", "", "", url, ""])
    return str(tmp_path / "list.csv"), str(dest)


def test_a_cancel_stops_a_running_fetch(spark, tmp_path):
    """The wave that hangs is interrupted, what was decided before is stored, and it stays cancelled."""
    path, dest = _hanging_manifest(tmp_path)
    state, got = str(tmp_path / "state"), []
    run = threading.Thread(target=lambda: got.append(J.run_file(spark, path, state, dest, task_id="t-1", num_partitions=3)))
    run.start()
    deadline = time.time() + 120
    while time.time() < deadline and not os.path.exists(f"{dest}/a.pdf"):      # the wave has begun
        time.sleep(0.5)
    assert os.path.exists(f"{dest}/a.pdf")
    answers = J.cancel_runs(spark, state, ["t-1", "unknown"]).collect()
    assert len(answers) == 2
    run.join(120)
    assert not run.is_alive() and got[0]["status"] == "cancelled"
    assert [r["status"] for r in J.read_runs(spark, state).collect()] == ["cancelled"]
    assert [(r["row_no"], r["outcome"]) for r in J.read_attempts(spark, state).collect()] == [(0, "already_downloaded")]
    assert [r["brnumber"] for r in J.read_catalog(spark, state).collect()] == ["K1"]
    # its file is free again, and what was fetched is found
    os.remove(tmp_path / "site" / "never.pdf")
    again = J.run_file(spark, path, state, dest, task_id="t-2")
    assert again["status"] == "finished"
    assert {r["brnumber"]: r["download_status"] for r in J.read_catalog(spark, state).collect()} == {
        "K1": "TRUE", "K2": "TRUE", "K3": "FALSE"}


def test_a_cancel_before_the_fetch(spark, tmp_path):
    path, dest = _hanging_manifest(tmp_path)
    state = str(tmp_path / "state")

    class Cancelled:
        settled = False

        def stopped(self):
            return True

        def settle(self):
            self.settled = True

    from docfetch.plans.run import run_manifest
    from docfetch.sources import manifest as M

    stop = Cancelled()
    manifest = M.read_manifests(spark, [path]).drop("missing_columns", "read_error", "file_row_no")
    res = run_manifest(manifest, spark.createDataFrame([("there.pdf",)], "file_name string"),
                       spark.createDataFrame([], S.CATALOG_SCHEMA), dest, "2024-06-01 00:00:00", stop=stop)
    assert stop.settled and res.attempts.count() == 1 and not os.path.exists(f"{dest}/a.pdf") and state
