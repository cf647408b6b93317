"""Session defaults and shared-storage scratch locations.

Nothing here is needed on a cluster whose session is already configured;
``get_session`` only fills in settings the caller left unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings this library relies on. AQE re-plans joins from runtime sizes
# (broadcast only when the measured side is under the threshold) and splits
# skewed shuffle partitions. Applied after start, and only when the job did not
# set the key itself (``spark-submit --conf`` wins).
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a join side is broadcast only when its size estimate (an upper bound for
    # scans; AQE re-checks the measured size) is under this; folder listings of
    # a run, per-run tables and small dimensions fall under it, catalogs do not
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Set before the context starts: no web UI (a non-interactive job), no console
# progress bars, no speculative copies of the side-effecting fetch tasks.
STATIC_DEFAULTS = {
    "spark.speculation": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
DEFAULTS = {**SQL_DEFAULTS, **STATIC_DEFAULTS}


def get_session(app_name: str = "docfetch", master: str | None = None,
                shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """The active session, or a new one. Keyword settings use ``__`` for dots
    (``spark__driver__memory="8g"``) and always apply."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in STATIC_DEFAULTS.items():
        builder = builder.config(key, value)
    explicit = {key.replace("__", "."): value for key, value in conf.items()}
    if shuffle_partitions is not None:
        explicit["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in explicit.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    submitted = spark.sparkContext.getConf()
    for key, value in SQL_DEFAULTS.items():
        if key not in explicit and not submitted.contains(key):
            spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    On a local master with the setting absent (tests, the local bench) a fresh
    folder under the system temp dir is set once; on a cluster an unset value
    is an error, because a machine-local folder is not visible to executors.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
        return root
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    root = tempfile.mkdtemp(prefix="docfetch-ckpt-")
    spark.conf.set("spark.checkpoint.dir", root)
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def shared_root(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, the same for every application
    (``sc.getCheckpointDir()`` is a new folder below it for each)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        checkpoint_root(spark)
        root = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_root(spark)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused location under the checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/docfetch/{name}-{uuid.uuid4().hex}"


def to_local_path(path: str) -> str:
    """``file:`` URI or plain path -> OS path (for executor-side file writes)."""
    if path.startswith("file://"):
        return path[len("file://"):]
    if path.startswith("file:"):
        return path[len("file:"):]
    return os.fspath(path)
