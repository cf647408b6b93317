"""Streaming: new manifest files dropped in a folder are run as they arrive (G1),
and run counters are kept live from an attempts stream (G2).

G1 streams only the *names* of new files (a ``binaryFile`` source whose
``content`` column is never selected, so nothing is read twice); each
micro-batch reads its files with the batch CSV/XLSX readers (header names,
row positions), runs them, and commits the next catalog version. foreachBatch
is at-least-once: files already recorded (by path and modification time, not by
batch number, which starts anew with every checkpoint) are skipped, so a replay
after a crash or a second watched folder neither repeats nor loses files.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfetch.operators import runs as RU
from docfetch.plans.job import FINISHED, run_and_store, store_rejected, write_run
from docfetch.session import shared_root
from docfetch.sources import manifest as M
from docfetch.sources import tables as TB

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


FILES_SCHEMA = "path string, modified timestamp, task_id string"


# G1
def ingest_stream(spark: SparkSession, in_dir: str, state_root: str, dest: str,
                  checkpoint: str | None = None, max_files_per_trigger: int = 1,
                  now=None, available_now: bool = True, fetch_kwargs: dict | None = None,
                  multi_line: bool = True, encoding: str = "UTF-8"):
    """Start the stream; returns the ``StreamingQuery``.

    State under ``state_root`` is that of ``plans.job`` (catalog, attempts, rejected,
    runs) and ``files``: the files taken so far, by path and modification time. A
    micro-batch is one task whose id follows from its files, so a replay writes the
    same partitions again, and one whose catalog version is already committed only
    records its files. Files of other formats are recorded in ``rejected``."""
    if checkpoint is None:  # the same after a restart: from the configured folder and the watched one
        digest = hashlib.sha1(f"{in_dir}|{state_root}".encode()).hexdigest()[:16]
        checkpoint = f"{shared_root(spark)}/docfetch/ingest-{digest}"
    fetch_kwargs = dict(fetch_kwargs or {})
    names = (spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
             .option("maxFilesPerTrigger", max_files_per_trigger).load(in_dir)
             .select("path", F.col("modificationTime").alias("modified")))

    def process(batch: DataFrame, batch_id: int) -> None:
        sp = batch.sparkSession
        done = TB.read_if_exists(sp, f"{state_root}/files", FILES_SCHEMA)
        todo = batch if done is None else batch.join(done, ["path", "modified"], "left_anti")
        found = sorted((r["path"], r["modified"]) for r in todo.distinct().collect())  # bounded by maxFilesPerTrigger
        if not found:
            return
        task_id = "ingest-" + hashlib.sha1(repr(found).encode()).hexdigest()[:24]
        paths = [p for p, _ in found if p.lower().endswith((".csv",) + M.WORKBOOK_EXTENSIONS)]
        others = [p for p, _ in found if p not in paths]
        if others:
            message = "Unsupported file format"
            store_rejected(sp.createDataFrame([(p, -1, message, [message]) for p in others],
                                              "source_file string, row_no long, read_error string, errors array<string>"),
                           state_root, task_id + "-files")
        if paths and not TB.is_committed(sp, f"{state_root}/catalog", task_id):
            stamp = now if now is not None else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
            start = stamp if isinstance(stamp, dt.datetime) else dt.datetime.fromisoformat(str(stamp))
            record = {"task_id": task_id, "name": "Download Task", "status": "running",
                      "running_file": ", ".join(p.rsplit("/", 1)[-1] for p in paths), "start_time": start,
                      "end_time": None, "processed_rows": 0, "start_row": 0, "num_rows": 0, "results": None}
            write_run(sp, state_root, record, 0)
            manifest = M.read_manifests(sp, paths, multi_line=multi_line, encoding=encoding)
            final = run_and_store(sp, manifest, state_root, dest, stamp, record, fetch_kwargs)
            write_run(sp, state_root, {**final, "end_time": start} if now is not None else final, FINISHED)
        sp.createDataFrame(found, "path string, modified timestamp").write.mode("overwrite") \
            .parquet(f"{state_root}/files/task_id={task_id}")

    writer = names.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


# G2
ATTEMPTS_STREAM_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType(), True),
    T.StructField("seq", T.LongType(), True),
    T.StructField("finished_at", T.TimestampNTZType(), True),
    T.StructField("outcome", T.StringType(), True),
])


def live_counts(attempts_stream: DataFrame, by: str = "run_id") -> DataFrame:
    """Streaming twin of F1: a stateful aggregate whose key set is the set of
    runs; in ``update`` mode each trigger emits the runs that changed."""
    return RU.outcome_counts(attempts_stream, by)


def track_progress(spark: SparkSession, attempts_stream: DataFrame, state_root: str,
                   checkpoint: str | None = None, by: str = "run_id", available_now: bool = False,
                   interval: str = "1 second", compact_every: int = 50):
    """Keep run progress durable while runs go on (the original saved it about
    once a second): the live counters run in ``update`` mode and every trigger
    writes the runs that changed, with their results JSON and the batch id, to
    ``state_root/progress``. ``read_progress`` gives the latest per run.

    Every ``compact_every`` batches the latest records become a new base and batches
    older than the base before it are removed, so files and what a reader reads stay
    bounded however long the stream goes on (a reader that began before a compaction
    still finds its files). Returns the ``StreamingQuery``."""
    if checkpoint is None:
        digest = hashlib.sha1(state_root.encode()).hexdigest()[:16]
        checkpoint = f"{shared_root(spark)}/docfetch/progress-{digest}"
    counts = RU.encode_results(live_counts(attempts_stream, by))
    root = f"{state_root}/progress"

    def sink(batch: DataFrame, batch_id: int) -> None:
        sp = batch.sparkSession
        # a replayed batch writes its folder again
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite") \
            .parquet(f"{root}/batches/{batch_id:012d}")
        if batch_id % compact_every == compact_every - 1 and f"{batch_id:012d}" not in TB.list_names(sp, f"{root}/marks"):
            _compact_progress(sp, root, by, batch_id)

    writer = counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def _compact_progress(spark: SparkSession, root: str, by: str, batch_id: int) -> None:
    """A base of the latest records up to this batch; what the base before it replaced goes."""
    before = _newest_base(spark, root)
    _latest_progress(spark, root, by).write.mode("overwrite").parquet(f"{root}/bases/{batch_id:012d}")
    TB.create_if_absent(spark, f"{root}/marks/{batch_id:012d}", "")
    if before is None:
        return
    for kind, keep_from in (("batches", int(before) + 1), ("bases", int(before)), ("marks", int(before))):
        for name in TB.list_names(spark, f"{root}/{kind}"):
            if name.isdigit() and int(name) < keep_from:
                TB.remove_tree(spark, f"{root}/{kind}/{name}")


def _newest_base(spark: SparkSession, root: str) -> str | None:
    return max((n for n in TB.list_names(spark, f"{root}/marks") if n.isdigit()), default=None)


def _latest_progress(spark: SparkSession, root: str, by: str) -> DataFrame:
    from docfetch.operators.keys import keep_extreme_per_key
    base = _newest_base(spark, root)
    paths = [f"{root}/batches/{n}" for n in TB.list_names(spark, f"{root}/batches")
             if n.isdigit() and (base is None or n > base)]
    log = spark.read.parquet(*([f"{root}/bases/{base}"] if base else []), *paths)
    return keep_extreme_per_key(log, [by], "batch_id", last=True)


def read_progress(spark: SparkSession, state_root: str, by: str = "run_id") -> DataFrame:
    """Latest progress record per run (a replayed batch writes the same values)."""
    return _latest_progress(spark, f"{state_root}/progress", by)
