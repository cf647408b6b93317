"""G2 made durable: live counters appended per trigger; the latest per run equals F1."""

import datetime as dt
import os
import time

from docfetch.operators.runs import outcome_counts
from docfetch.streaming.ingest import ATTEMPTS_STREAM_SCHEMA, read_progress, track_progress


def test_progress_table_follows_the_stream(spark, tmp_path):
    drop, state = tmp_path / "attempts", tmp_path / "state"
    drop.mkdir()
    base = dt.datetime(2024, 1, 1)
    outcomes = ["successful", "failed", "already_downloaded"]
    rows = [(r % 3, i, base + dt.timedelta(seconds=i), outcomes[i % 3]) for i, r in enumerate(range(30))]
    t = time.time()
    for part in range(3):
        chunk = rows[part * 10:(part + 1) * 10]
        path = str(drop / f"part{part}")
        spark.createDataFrame(chunk, ATTEMPTS_STREAM_SCHEMA).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(os.path.join(path, f), (t + part, t + part))
    stream = (spark.readStream.schema(ATTEMPTS_STREAM_SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(drop)))
    q = track_progress(spark, stream, str(state), checkpoint=str(tmp_path / "ck"), available_now=True)
    q.awaitTermination()
    log = spark.read.parquet(str(state / "progress" / "batches" / "*"))
    assert log.select("batch_id").distinct().count() == 3          # one record set per trigger
    got = {r.run_id: r for r in read_progress(spark, str(state)).collect()}
    want = {r.run_id: r for r in outcome_counts(spark.createDataFrame(rows, ATTEMPTS_STREAM_SCHEMA)).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert (got[k].successful, got[k].failed, got[k].processed_rows) == (w.successful, w.failed, w.processed_rows)
        assert got[k].results.startswith('{"successful": ')


def test_files_stay_bounded(spark, tmp_path):
    """Many triggers, compaction every four: the newest base, two generations of batches, the same counters."""
    attempts = spark.createDataFrame([(i % 3, i, "successful" if i % 2 else "failed") for i in range(46)],
                                     "run_id long, seq long, outcome string")
    for i in range(23):
        attempts.where(f"seq % 23 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(attempts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = str(tmp_path / "state")
    track_progress(spark, stream, state, checkpoint=str(tmp_path / "ck"), available_now=True, compact_every=4).awaitTermination()
    left = {kind: sorted(os.listdir(f"{state}/progress/{kind}")) for kind in ("batches", "bases", "marks")}
    assert len(left["bases"]) == 2 and 4 <= len(left["batches"]) <= 8
    want = {r.run_id: (r.successful, r.failed, r.processed_rows) for r in outcome_counts(attempts).collect()}
    got = {r.run_id: (r.successful, r.failed, r.processed_rows) for r in read_progress(spark, state).collect()}
    assert got == want
