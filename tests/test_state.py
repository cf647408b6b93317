"""What a run leaves behind: positions, commits, replays, listings, refusals."""

import csv
import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from docfetch import schemas as S
from docfetch.plans import job as J
from docfetch.sources import log_table as LT
from docfetch.sources import tables as TB
from docfetch.streaming import ingest as I

NOW = dt.datetime(2024, 6, 1, 8, 0, 0)


def _site(tmp_path, names="abc"):
    site = tmp_path / "site"
    site.mkdir()
    for n in names:
        (site / f"{n}.pdf").write_bytes(b"%PDF-1.4 " + n.encode())
    return f"file://{site}"


def _csv(path, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(list(S.MANIFEST_COLUMN_MAP))
        w.writerows([k, k, "2020", "", "", "", "", "", url, ""] for k, url in rows)


def _catalog(spark, state):
    return {r.brnumber: r for r in J.read_catalog(spark, str(state)).collect()}


def test_manifest_of_several_part_files(spark, tmp_path):
    u = _site(tmp_path)
    folder = tmp_path / "list.csv"
    folder.mkdir()
    _csv(folder / "part-0.csv", [("K1", f"{u}/a.pdf"), ("K2", f"{u}/c.pdf")])
    _csv(folder / "part-1.csv", [("K3", f"{u}/none.pdf"), ("K4", f"{u}/b.pdf")])
    rec = J.run_file(spark, str(folder), str(tmp_path / "state"), str(tmp_path / "dest"), now=NOW)
    cat = _catalog(spark, tmp_path / "state")
    assert {k: (r.download_status, r.file_name) for k, r in cat.items()} == {
        "K1": ("TRUE", "a.pdf"), "K2": ("TRUE", "c.pdf"), "K3": ("FALSE", ""), "K4": ("TRUE", "b.pdf")}
    assert len({r.id for r in cat.values()}) == 4 and '"failed": 1' in rec["results"]


def test_repeated_positions_are_refused_before_the_fetch(spark, tmp_path):
    from docfetch.plans.run import run_manifest

    columns = list(S.MANIFEST_COLUMN_MAP.values())
    rows = spark.createDataFrame([(0, *["x"] * len(columns))] * 2, "row_no long, " + ", ".join(f"{c} string" for c in columns))
    with pytest.raises(ValueError, match="more than once"):
        run_manifest(rows, spark.createDataFrame([], "file_name string"), spark.createDataFrame([], S.CATALOG_SCHEMA),
                     str(tmp_path / "dest"), NOW)


def test_target_folder_is_created_or_refused(spark, tmp_path):
    u = _site(tmp_path)
    _csv(tmp_path / "l.csv", [("K1", f"{u}/a.pdf")])
    J.run_file(spark, str(tmp_path / "l.csv"), str(tmp_path / "state"), str(tmp_path / "new" / "dest"), now=NOW)
    assert os.listdir(tmp_path / "new" / "dest") == ["a.pdf"]
    with pytest.raises(ValueError, match="mounted path"):
        J.run_file(spark, str(tmp_path / "l.csv"), str(tmp_path / "state"), "s3a://bucket/dest", now=NOW)


def test_listing_keeps_hidden_names(spark, tmp_path):
    for name in ("a.pdf", "_b.pdf", ".pdf", "_k=v.pdf"):
        (tmp_path / name).write_bytes(b"%PDF-")
    names = [r.file_name for r in TB.list_stored_files(spark, str(tmp_path)).collect()]
    assert sorted(names) == [".pdf", "_b.pdf", "_k=v.pdf", "a.pdf"]
    assert TB.list_stored_files(spark, str(tmp_path / "absent")).count() == 0


def test_broken_download_leaves_no_part_file(tmp_path, monkeypatch):
    import io
    import urllib.request

    from docfetch.operators import fetch as FE

    class Breaking(io.BytesIO):
        def read(self, n=-1):
            if self.tell() >= 5:
                raise OSError("connection lost")
            return super().read(n)

    monkeypatch.setattr(urllib.request, "urlopen", lambda *a, **k: Breaking(b"%PDF-1.4"))
    assert FE._fetch_one("http://x/y.pdf", "y.pdf", b"%PDF-", str(tmp_path), 1.0, 4)[0] == "failed"
    assert os.listdir(tmp_path) == []


def test_interleaved_commits_keep_both(spark, tmp_path):
    """The second writer's version is computed from the first one's, whoever read first."""
    root = str(tmp_path / "t")
    schema = "k string, v long"
    add = lambda k: lambda t: t.unionByName(spark.createDataFrame([(k, 1)], schema))
    TB.update_table(spark, root, add("a"), schema)
    base = TB.read_latest(spark, root)
    number = TB.latest_commit(spark, root)[0]
    TB.update_table(spark, root, add("b"), schema)                        # commits in between
    with pytest.raises(TB.VersionConflict):
        TB.save_table(add("c")(base), root, expected=number)
    threads = [threading.Thread(target=TB.update_table, args=(spark, root, add(k), schema)) for k in "cde"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r.k for r in TB.read_latest(spark, root).collect()) == list("abcde")


def test_files_of_a_version_cover_disjoint_keys(spark, tmp_path):
    df = spark.range(5000).select(F.format_string("BR%06d", F.col("id") * 7919 % 5000).alias("brnumber"))
    path = TB.save_table(df, str(tmp_path / "t"), bucket_by="brnumber", num_buckets=4)
    ranges = sorted((r[0], r[1]) for r in spark.read.parquet(path).groupBy(F.input_file_name())
                    .agg(F.min("brnumber"), F.max("brnumber")).select("min(brnumber)", "max(brnumber)").collect())
    assert len(ranges) == 4 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_unreadable_state_is_not_an_empty_table(spark, tmp_path):
    u = _site(tmp_path)
    _csv(tmp_path / "l.csv", [("K1", f"{u}/a.pdf")])
    state = tmp_path / "state"
    J.run_file(spark, str(tmp_path / "l.csv"), str(state), str(tmp_path / "dest"), now=NOW)
    _csv(tmp_path / "m.csv", [("K2", f"{u}/b.pdf")])
    versions = state / "catalog" / "versions"
    (versions / "000000000002.json").write_text("not a commit")
    with pytest.raises(Exception):
        J.run_file(spark, str(tmp_path / "m.csv"), str(state), str(tmp_path / "dest"), now=NOW)
    (versions / "000000000002.json").unlink()
    assert set(_catalog(spark, state)) == {"K1"}
    (state / "runs").rename(tmp_path / "kept-runs")
    (state / "runs").write_text("a file where a table should be")
    with pytest.raises(Exception):
        J.run_file(spark, str(tmp_path / "m.csv"), str(state), str(tmp_path / "dest"), now=NOW)


def _ended(spark, state, task_id, name="l.csv"):
    J.write_run(spark, state, {"task_id": task_id, "name": "n", "status": "failed", "running_file": name,
                               "start_time": NOW, "end_time": NOW, "processed_rows": 0, "start_row": 0, "num_rows": 0,
                               "results": None}, J.FAILED)


def test_admission_is_one_create(spark, tmp_path):
    state = str(tmp_path / "state")
    first = J._admit(spark, state, "l.csv", "t1")
    with pytest.raises(J.RunRefused):
        J._admit(spark, state, "l.csv", "t2")
    J._admit(spark, state, "other.csv", "t3")
    _ended(spark, state, "t1")                                            # its driver was lost, it is not marked done
    second = J._admit(spark, state, "l.csv", "t4")
    assert first.endswith("000000001") and second.endswith("000000002")
    with pytest.raises(J.RunRefused):
        J._admit(spark, state, "l.csv", "t5")
    J._release(spark, second)
    assert J._admit(spark, state, "l.csv", "t6").endswith("000000003")


def test_two_starters_find_a_stale_lock(spark, tmp_path, monkeypatch):
    """Both look before either creates: one of them runs."""
    state = str(tmp_path / "state")
    J._admit(spark, state, "l.csv", "t1")
    _ended(spark, state, "t1")
    real, ready, got = TB.create_if_absent, threading.Barrier(2), []

    def create(*args):
        ready.wait(60)
        return real(*args)

    def start(task):
        try:
            got.append(J._admit(spark, state, "l.csv", task))
        except J.RunRefused:
            got.append(None)

    monkeypatch.setattr(TB, "create_if_absent", create)
    threads = [threading.Thread(target=start, args=(t,)) for t in ("t2", "t3")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(got) == 2 and got.count(None) == 1


def test_progress_and_report_of_a_run(spark, tmp_path):
    u = _site(tmp_path)
    _csv(tmp_path / "l.csv", [("K1", f"{u}/a.pdf"), ("K2", f"{u}/none.pdf"), ("K3", f"{u}/a.pdf")])
    state = str(tmp_path / "state")
    rec = J.run_file(spark, str(tmp_path / "l.csv"), state, str(tmp_path / "dest"), now=NOW)
    log = spark.read.schema(J.RUN_LOG_SCHEMA).parquet(f"{state}/runs")
    assert [(r.version, r.processed_rows) for r in log.orderBy("version").collect()] == [
        (0, 0), (1, 2), (2, 3), (J.FINISHED, 3)]
    got = J.report(spark, state, "2024-06-02 00:00:00").first()
    assert got.task_id == rec["task_id"] and got.results == rec["results"] and got.state == "finished"


def _drop_stream(spark, folder, state, dest, ck):
    I.ingest_stream(spark, str(folder), str(state), str(dest), checkpoint=str(ck),
                    now="2024-06-01 00:00:00").awaitTermination()


def test_two_watched_folders_share_a_state(spark, tmp_path):
    u = _site(tmp_path)
    for n, k in (("one", "A1"), ("two", "B1")):
        (tmp_path / n).mkdir()
        _csv(tmp_path / n / "l.csv", [(k, f"{u}/a.pdf")])
        (tmp_path / n / "notes.txt").write_text("not a manifest")
        _drop_stream(spark, tmp_path / n, tmp_path / "state", tmp_path / "dest", tmp_path / f"ck-{n}")
    assert set(_catalog(spark, tmp_path / "state")) == {"A1", "B1"}
    rejected = spark.read.parquet(str(tmp_path / "state" / "rejected"))
    assert sorted(r.source_file.rsplit("/", 1)[-1] for r in rejected.collect()) == ["notes.txt"] * 2
    assert J.read_runs(spark, str(tmp_path / "state")).where("status = 'finished'").count() == 2


def test_new_checkpoint_repeats_nothing(spark, tmp_path):
    """Another application (or a lost checkpoint) numbers its batches anew."""
    u = _site(tmp_path)
    (tmp_path / "in").mkdir()
    _csv(tmp_path / "in" / "1.csv", [("K1", f"{u}/a.pdf")])
    _drop_stream(spark, tmp_path / "in", tmp_path / "state", tmp_path / "dest", tmp_path / "ck1")
    _csv(tmp_path / "in" / "2.csv", [("K2", f"{u}/b.pdf")])
    _drop_stream(spark, tmp_path / "in", tmp_path / "state", tmp_path / "dest", tmp_path / "ck2")
    assert set(_catalog(spark, tmp_path / "state")) == {"K1", "K2"}
    assert J.read_attempts(spark, str(tmp_path / "state")).count() == 2


@pytest.mark.parametrize("at", ["upsert", "write_run"])
def test_crash_inside_a_batch_adds_nothing_twice(spark, tmp_path, monkeypatch, at):
    """A crash after the attempts were written, or after the catalog was committed."""
    u = _site(tmp_path)
    (tmp_path / "in").mkdir()
    _csv(tmp_path / "in" / "1.csv", [("K1", f"{u}/a.pdf"), ("", f"{u}/b.pdf")])
    real, calls = getattr(LT if at == "upsert" else I, at), []

    def crash(*args, **kw):
        calls.append(args)
        if at == "upsert" or args[3] == J.FINISHED:
            raise OSError("driver lost")
        return real(*args, **kw)

    with monkeypatch.context() as m:
        m.setattr(LT if at == "upsert" else I, at, crash)
        with pytest.raises(Exception):
            _drop_stream(spark, tmp_path / "in", tmp_path / "state", tmp_path / "dest", tmp_path / "ck")
    _drop_stream(spark, tmp_path / "in", tmp_path / "state", tmp_path / "dest", tmp_path / "ck")
    assert calls and set(_catalog(spark, tmp_path / "state")) == {"K1"}
    assert J.read_attempts(spark, str(tmp_path / "state")).count() == 1
    assert spark.read.parquet(str(tmp_path / "state" / "rejected")).count() == 1


def test_replay_after_many_commits(spark, tmp_path):
    """A note is found however many versions came after it; one that was only announced is not."""
    root = str(tmp_path / "t")
    schema = "brnumber string, row_no long"
    full = spark.createDataFrame([("K", 1)], schema)
    TB.save_table(full, root, note="first")
    for n in range(60):
        assert TB.create_if_absent(spark, f"{root}/versions/{n + 2:012d}.json", '{"path": "x", "note": null}')
    assert TB.is_committed(spark, root, "first") and not TB.is_committed(spark, root, "other")
    TB.write_note(spark, root, "lost", 62)                                # the driver was lost before the commit
    assert not TB.is_committed(spark, root, "lost")
    TB.create_if_absent(spark, f"{root}/versions/{62:012d}.json", '{"path": "x", "note": "another"}')
    assert not TB.is_committed(spark, root, "lost")


def test_replayed_batch_after_other_commits_changes_nothing(spark, tmp_path):
    u = _site(tmp_path)
    (tmp_path / "in").mkdir()
    _csv(tmp_path / "in" / "1.csv", [("K1", f"{u}/none.pdf")])
    state = tmp_path / "state"
    _drop_stream(spark, tmp_path / "in", state, tmp_path / "dest", tmp_path / "ck1")
    rows = spark.createDataFrame([("K1", "newer", "TRUE", 0)], "brnumber string, title string, download_status string, row_no long")
    LT.upsert(spark, f"{state}/catalog", rows, S.CATALOG_SCHEMA)
    number, commit = LT.read_commit(spark, f"{state}/catalog")
    for n in range(60):                                                   # others commit meanwhile
        assert LT._commit(spark, f"{state}/catalog", number + 1 + n, {**commit, "note": None})
    (state / "files").rename(tmp_path / "lost-files")                    # the batch is not recorded: it is replayed
    _drop_stream(spark, tmp_path / "in", state, tmp_path / "dest", tmp_path / "ck2")
    assert {k: (r.title, r.download_status) for k, r in _catalog(spark, state).items()} == {"K1": ("newer", "TRUE")}
