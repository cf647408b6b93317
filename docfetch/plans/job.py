"""A complete batch run of one manifest file, with its run record.

``run_file`` is the whole "start a download run" flow as one Spark job: check
the extension (B7) and that no run of the same file is running (F6), read the
file (A1/A2), slice it (B1), map and check it (B2/B3), run it (C3-C7, D1),
then commit the next catalog version (A7) and write the run record with its
counters as JSON (F8).

State lives under ``state_root``. ``catalog`` is a log table (``sources.log_table``): a
run adds a delta of its rows, and of two runs that end together the later one applies
its updates to the version the earlier one committed. ``attempts`` and ``rejected`` are partitioned by ``task_id`` and a
task writes its partition as a whole, so a repeated task adds nothing twice.
``admission`` holds a folder per manifest file: a run is admitted by creating the next
number in it, only if absent, and ends by marking it done.
``runs`` is an append-only log of run records; the highest ``version`` per task is
current: 0 started, then one per fetch wave, 1000 failed, 2000 cancelled, 3000
finished - a cancel recorded while the run was going is kept when the run ends.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfetch import schemas as S
from docfetch.functions import columns as C
from docfetch.operators import prepare as P
from docfetch.sources import log_table as LT
from docfetch.sources import manifest as M
from docfetch.sources import tables as TB

FAILED, CANCELLED, FINISHED = 1000, 2000, 3000
COUNTS = ("successful", "already_downloaded", "failed", "processed_rows")
ATTEMPTS_SCHEMA = ("row_no long, attempt int, url string, stored_name string, file_folder string, outcome string, "
                   "message string, finished_at timestamp_ntz, run_id long, task_id string")
REJECTED_SCHEMA = ("source_file string, row_no long, file_row_no long, "
                   + ", ".join(f"{c} string" for c in S.MANIFEST_COLUMN_MAP.values())
                   + ", missing_columns array<string>, read_error string, errors array<string>")


class RunRefused(ValueError):
    """The run cannot start (unsupported file, or a run of it is running)."""


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def read_runs(spark: SparkSession, state_root: str) -> DataFrame:
    """Current state of every run: the latest record per ``task_id``."""
    log = TB.read_if_exists(spark, f"{state_root}/runs", RUN_LOG_SCHEMA)
    if log is None:
        return spark.createDataFrame([], S.RUN_SCHEMA)
    from docfetch.operators.keys import keep_extreme_per_key
    return keep_extreme_per_key(log, ["task_id"], "version", last=True).select(*S.RUN_SCHEMA.fieldNames())


RUN_LOG_SCHEMA = T.StructType(list(S.RUN_SCHEMA.fields) + [T.StructField("version", T.LongType(), True)])


def write_run(spark: SparkSession, state_root: str, record: dict, version: int) -> None:
    row = {**record, "version": version}
    spark.createDataFrame([row], RUN_LOG_SCHEMA).write.mode("append").parquet(f"{state_root}/runs")


def read_catalog(spark: SparkSession, state_root: str) -> DataFrame:
    """The catalog after the last committed run."""
    return LT.read(spark, f"{state_root.rstrip('/')}/catalog", S.CATALOG_SCHEMA)


def run_file(spark: SparkSession, path: str, state_root: str, dest: str, start_row: int | None = None,
             num_rows: int | None = None, now: dt.datetime | None = None, task_id: str | None = None,
             **fetch_kwargs) -> dict:
    """Run one manifest file; returns the final run record (a dict)."""
    name = os.path.basename(path.rstrip("/"))
    ext = os.path.splitext(name)[1]
    if ext not in S.RUN_EXTENSIONS:
        raise RunRefused(f"Unsupported file format: {ext}")
    task_id = task_id or str(uuid.uuid4())
    lock = _admit(spark, state_root, name, task_id)
    try:
        start = now or _now()
        record = {"task_id": task_id, "name": "Download Task", "status": "running", "running_file": name,
                  "start_time": start, "end_time": None, "processed_rows": 0,
                  "start_row": int(start_row or 0), "num_rows": int(num_rows or 0), "results": None}
        write_run(spark, state_root, record, 0)
        watch = CancelWatch(spark, state_root, task_id)
        try:
            rows = M.read_manifests(spark, [path], **{k: fetch_kwargs.pop(k) for k in ("multi_line", "encoding")
                                                      if k in fetch_kwargs})
            unreadable = F.col("read_error").isNotNull()
            # a file that cannot be read has one row (position -1): report it whatever the slice
            manifest = P.slice_rows(rows.where(~unreadable), start_row, num_rows).unionByName(rows.where(unreadable))
            final = run_and_store(spark, manifest, state_root, dest, start, record, fetch_kwargs, watch)
        except Exception:
            if watch.stopped():                          # cancelled before anything was fetched
                return {**record, "status": "cancelled", "end_time": _now()}
            # never leave a crashed run "running": it would block its file forever
            write_run(spark, state_root, {**record, "status": "failed", "end_time": _now()}, FAILED)
            raise
        finally:
            watch.settle()
        # a run cancelled while it ran stays cancelled (cancelled is terminal)
        current = read_runs(spark, state_root).where(F.col("task_id") == task_id).select("status").first()
        if current is not None and current["status"] == "cancelled":
            final = {**final, "status": "cancelled"}
        if now is not None:
            final = {**final, "end_time": now}
        write_run(spark, state_root, final, FINISHED)
        return final
    finally:
        _release(spark, lock)


class CancelWatch:
    """Stops a run's Spark jobs when the run is cancelled (F7), also from another process.

    The run's thread tags its jobs with the task id; a thread of the driver looks for the
    cancel's marker file and then cancels the tag's jobs, again and again until the run has
    settled (a wave is several jobs). Tags of the context, not of the session: those are
    known only to the thread that sets them."""

    def __init__(self, spark: SparkSession, state_root: str, task_id: str, interval: float = 1.0):
        self._spark, self._tag, self._interval = spark, task_id, interval
        self._marker = _cancel_marker(state_root, task_id)
        self._cancelled, self._settled = threading.Event(), threading.Event()
        spark.sparkContext.addJobTag(task_id)
        spark.sparkContext.setInterruptOnCancel(True)
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()

    def _watch(self) -> None:
        while not self._settled.wait(self._interval):
            if self._cancelled.is_set() or TB.read_text_file(self._spark, self._marker) is not None:
                self._cancelled.set()
                self._spark.sparkContext.cancelJobsWithTag(self._tag)

    def stopped(self) -> bool:
        return self._cancelled.is_set()

    def settle(self) -> None:
        """Called by the run's own thread."""
        self._settled.set()
        self._thread.join()
        self._spark.sparkContext.removeJobTag(self._tag)
        self._spark.sparkContext.setInterruptOnCancel(False)


def _cancel_marker(state_root: str, task_id: str) -> str:
    return f"{state_root}/cancels/{task_id}"


def _admit(spark: SparkSession, state_root: str, name: str, task_id: str) -> str:
    """Admission (F6). Returns the path of the run's own number in the file's folder.

    The next number is created only if absent, so of starters that all find the last
    one done, or its run ended without marking it (its driver was lost), one passes."""
    folder = f"{state_root}/admission/{hashlib.sha1(name.encode()).hexdigest()}"
    taken = TB.list_names(spark, folder)
    last = max((int(x) for x in taken if x.isdigit()), default=0)
    runs = read_runs(spark, state_root)
    running = runs.where((F.col("running_file") == name) & (F.col("status") == "running")).select("task_id")
    holder = TB.read_text_file(spark, f"{folder}/{last:09d}") if last else None
    free = last == 0 or f"{last:09d}.done" in taken or (
        holder is not None and runs.where((F.col("task_id") == holder) & (F.col("status") != "running")).first() is not None)
    if not free or running.first() is not None:
        raise RunRefused(S.MSG_TASK_RUNNING)
    own = f"{folder}/{last + 1:09d}"
    if not TB.create_if_absent(spark, own, task_id):
        raise RunRefused(S.MSG_TASK_RUNNING)
    return own


def _release(spark: SparkSession, own: str) -> None:
    TB.create_if_absent(spark, f"{own}.done", "")


def run_and_store(spark: SparkSession, manifest: DataFrame, state_root: str, dest: str, start, record: dict,
                  fetch_kwargs: dict, stop: CancelWatch | None = None) -> dict:
    """Run manifest rows and store rejects, attempts, progress and the catalog under
    the record's ``task_id``; returns the finished record. A run that is stopped stores
    what its waves before had done."""
    from docfetch.operators.fetch import prepare_folder
    from docfetch.plans.run import run_manifest

    prepare_folder(dest)
    task_id = record["task_id"]
    valid, rejected = P.validate_rows(manifest, P.manifest_key_rules())
    store_rejected(rejected, state_root, task_id)
    valid = valid.drop("missing_columns", "read_error", "file_row_no")

    catalog = read_catalog(spark, state_root)
    files = TB.list_stored_files(spark, dest).select("file_name")
    wave = iter(range(1, FAILED))

    def progress(attempts: DataFrame) -> None:
        counted = _counted(attempts)
        write_run(spark, state_root, {**record, "processed_rows": counted["processed_rows"],
                                       "results": counted["results"]}, next(wave))

    res = run_manifest(valid, files, catalog, dest, start, progress=progress, stop=stop, **fetch_kwargs)
    res.attempts.write.mode("overwrite").parquet(f"{state_root}/attempts/task_id={task_id}")
    LT.upsert(spark, f"{state_root}/catalog", res.updates, S.CATALOG_SCHEMA, note=task_id)
    counted = _counted(res.attempts.where("attempt = 1"))
    return {**record, "status": "finished", "end_time": _now(),
            "processed_rows": counted["processed_rows"], "results": counted["results"]}


def store_rejected(rejected: DataFrame, state_root: str, task_id: str) -> None:
    spark = rejected.sparkSession
    (spark.createDataFrame([], REJECTED_SCHEMA).unionByName(rejected, allowMissingColumns=True)
     .write.mode("overwrite").parquet(f"{state_root}/rejected/task_id={task_id}"))


def _counted(attempts: DataFrame):
    from docfetch.operators.runs import outcome_counts

    counts = outcome_counts(attempts.withColumn("run_id", F.lit(0)))
    totals = counts.agg(*[F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in COUNTS])
    return totals.select(C.encode_results(*COUNTS).alias("results"), "processed_rows").first()


def read_attempts(spark: SparkSession, state_root: str) -> DataFrame:
    """Every stored attempt, with the ``task_id`` of its run."""
    found = TB.read_if_exists(spark, f"{state_root}/attempts", ATTEMPTS_SCHEMA)
    return spark.createDataFrame([], ATTEMPTS_SCHEMA) if found is None else found


def report(spark: SparkSession, state_root: str, now) -> DataFrame:
    """F10 over the stored runs and their attempts (first attempts count)."""
    from docfetch.operators.runs import run_report

    return run_report(read_runs(spark, state_root), read_attempts(spark, state_root).where("attempt = 1"), now,
                      by="task_id")


def cancel_runs(spark: SparkSession, state_root: str, task_ids: list[str]) -> DataFrame:
    """Cancel requests (F7) applied to the stored runs; the new states are
    recorded, the runs' drivers told to stop, and the answers returned."""
    from docfetch.operators.runs import apply_cancels

    runs = read_runs(spark, state_root)
    req = spark.createDataFrame([(i, t) for i, t in enumerate(task_ids)], "seq long, task_id string")
    after, answered = apply_cancels(runs, req)
    changed = after.join(runs.where(F.col("status") == "running").select("task_id"), "task_id", "left_semi") \
        .where(F.col("status") == "cancelled")
    stopped = [r["task_id"] for r in changed.select("task_id").collect()]        # at most the ids asked for
    changed.withColumn("version", F.lit(CANCELLED).cast("long")).select(*RUN_LOG_SCHEMA.fieldNames()) \
        .write.mode("append").parquet(f"{state_root}/runs")
    for task_id in stopped:                              # the runs' drivers look for these
        TB.create_if_absent(spark, _cancel_marker(state_root, task_id), task_id)
    return answered
