"""Run tracking cases of SURVEY §2.9 (Q4, Q9, Q10, Q11) and C5 on file bodies."""

import datetime as dt

from docfetch.operators import fetch as FE
from docfetch.operators import runs as RU

T0 = dt.datetime(2024, 1, 1, 8, 0, 0)


def _runs(spark, rows):
    return spark.createDataFrame(
        rows, "task_id long, running_file string, status string, start_time timestamp_ntz, "
              "end_time timestamp_ntz, processed_rows long, num_rows long")


def test_cancel_is_terminal_and_reported(spark):
    runs = _runs(spark, [(1, "a.xlsx", "running", T0, T0, 5, 10), (2, "b.xlsx", "finished", T0, T0, 3, 3)])
    cancels = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 99)], "seq long, task_id long")
    after, answered = RU.apply_cancels(runs, cancels)
    msgs = {r.seq: r.message for r in answered.collect()}
    assert msgs == {10: "Task cancelled", 11: "Task is already finished",
                    12: "Task is already finished", 13: "No such task"}
    status = {r.task_id: r.status for r in after.collect()}
    assert status == {1: "cancelled", 2: "finished"}                       # Q9: stays cancelled
    attempts = spark.createDataFrame([(1, 1, T0, "successful")], "run_id long, seq long, finished_at timestamp_ntz, outcome string")
    report = {r.task_id: r for r in RU.run_report(after, attempts, T0 + dt.timedelta(hours=1)).collect()}
    assert report[1].status == "cancelled" and report[1].results.startswith('{"successful": 1')   # Q10


def test_zero_row_run_finishes_with_zeros(spark):
    runs = _runs(spark, [(7, "empty.csv", "finished", T0, T0 + dt.timedelta(seconds=3725), 0, 0)])
    attempts = spark.createDataFrame([], "run_id long, seq long, finished_at timestamp_ntz, outcome string")
    r = RU.run_report(runs, attempts, T0).first()
    assert r.results == '{"successful": 0, "already_downloaded": 0, "failed": 0, "processed_rows": 0}'  # Q11
    assert r.progress is None and r.state == "finished"
    assert r.running_seconds == 3725 and r.running_time == "1 hours, 2 minutes, 5 seconds"


def test_finalizing_shown_at_hundred_percent(spark):
    runs = _runs(spark, [(1, "a.xlsx", "running", T0, T0, 10, 10), (2, "b.xlsx", "running", T0, T0, 9, 10)])
    st = {r.task_id: r.state for r in RU.progress_state(runs).collect()}
    assert st == {1: "finalizing", 2: "running"}


def test_reference_counters_versus_true_totals(spark):
    """Q4: a row rescued by its backup URL counts as failed in the reference counters."""
    a = spark.createDataFrame([(0, 1, 1, "failed"), (0, 1, 2, "successful"), (0, 2, 1, "successful")],
                              "run_id long, row_no long, attempt int, outcome string")
    first = RU.outcome_counts(a, attempts_to_count="first").first()
    last = RU.outcome_counts(a, attempts_to_count="last").first()
    assert (first.successful, first.failed, first.processed_rows) == (1, 1, 2)
    assert (last.successful, last.failed, last.processed_rows) == (2, 0, 2)


def test_signature_on_binary_file_content(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 body")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    (tmp_path / "c.pdf").write_bytes(b"%PD")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    got = {r.path.rsplit("/", 1)[-1]: r.signature_ok for r in FE.check_signature(files).collect()}
    assert got == {"a.pdf": True, "b.pdf": False, "c.pdf": False}


def _elapsed(rows, seconds, starts=None):
    """Rows (run, seq, time or None): the (run, seq) kept by the original's rule."""
    kept = set()
    for run in {r for r, _, _ in rows}:
        own = sorted(((t is not None, t or T0, s) for r, s, t in rows if r == run))
        timed = [(t, s) for has, t, s in own if has]
        last = (starts or {}).get(run, timed[0][0] if timed else None)
        for t, s in timed:
            if last is not None and t - last >= dt.timedelta(seconds=seconds):
                kept.add((run, s))
                last = t
        kept.add((run, own[-1][2]))
    return kept


def test_sample_elapsed(spark):
    """Bursts on one time stamp, pauses, a hot run, a null run, rows without a time, given starts."""
    import random

    rng = random.Random(7)
    rows, seq = [], 0
    for run, n in ((1, 400), (2, 40), (None, 30), (3, 1), (4, 60)):
        t = T0
        for _ in range(n):
            seq += 1
            t += dt.timedelta(seconds=rng.choice([0, 0, 0.2, 0.5, 1, 1.5, 30]))
            rows.append((run, seq, None if run == 4 and rng.random() < 0.2 else t))
    df = spark.createDataFrame([(*r, "failed") for r in rows], "run_id long, seq long, finished_at timestamp_ntz, outcome string")
    for seconds in (1, 2, 100):
        got = RU.sample_elapsed(df.repartition(3), seconds).collect()
        assert {(r["run_id"], r["seq"]) for r in got} == _elapsed(rows, seconds) and len(got) == len(_elapsed(rows, seconds))
    starts = {1: T0 - dt.timedelta(days=1), 2: T0 + dt.timedelta(seconds=20), 3: T0, 4: T0, None: T0}
    known = spark.createDataFrame(list(starts.items()), "run_id long, start_time timestamp_ntz")
    got = RU.sample_elapsed(df, 1, starts=known).collect()
    assert {(r["run_id"], r["seq"]) for r in got} == _elapsed(rows, 1, starts)
