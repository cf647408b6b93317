"""Fetching documents (C4-C6).

Rows are spread over ``num_partitions`` tasks by a hash of ``row_no`` (even,
and the same on a retry); each task opens its URLs in order inside
``mapInPandas``. Partitions replace the original's thread pool; the number of
partitions caps the number of open connections.

Side effects under retry: a file is written to ``dest/.docfetch-<uuid>.part`` and
renamed into place, so a killed task leaves no half file under the real name
and a re-run simply writes the same name again. Callers materialise the
attempts once (``persist_attempts``) so later actions never re-run the fetch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfetch import schemas as S

FETCH_OUT = T.StructType([
    T.StructField("row_no", T.LongType(), True),
    T.StructField("url", T.StringType(), True),
    T.StructField("stored_name", T.StringType(), True),
    T.StructField("outcome", T.StringType(), True),
    T.StructField("message", T.StringType(), True),
    T.StructField("bytes_written", T.LongType(), True),
    T.StructField("finished_at", T.TimestampNTZType(), True),
])


def _fetch_one(url, name, signature: bytes, dest: str | None, timeout: float, chunk: int):
    """(outcome, message, bytes written) for one URL."""
    import os
    import urllib.request
    import uuid

    if url is None or (isinstance(url, float) and url != url):
        return "failed", S.MSG_MISSING_URL, None
    try:
        with urllib.request.urlopen(url, timeout=timeout) as resp:
            head = resp.read(len(signature))
            if not head.startswith(signature):
                return "failed", S.MSG_NOT_PDF, None
            if dest is None:
                return "successful", None, None
            n = len(head)
            final = os.path.join(dest, name)
            tmp = os.path.join(dest, f".docfetch-{uuid.uuid4().hex}.part")
            try:
                with open(tmp, "wb") as out:
                    out.write(head)
                    while True:
                        block = resp.read(chunk)
                        if not block:
                            break
                        out.write(block)
                        n += len(block)
                os.replace(tmp, final)
            finally:
                if os.path.exists(tmp):      # a download that broke off leaves nothing behind
                    os.unlink(tmp)
            return "successful", S.MSG_DOWNLOADED, n
    except Exception as e:  # noqa: BLE001 - every failure is an outcome
        return "failed", str(e), None


def _fetch_batches(batches, signature: bytes, dest: str | None, timeout: float,
                   concurrency: int = 1, chunk: int = 1 << 20):
    import datetime as dt
    from concurrent.futures import ThreadPoolExecutor

    import pandas as pd

    def one(pair):
        r = _fetch_one(pair[0], pair[1], signature, dest, timeout, chunk)
        return r + (dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),)

    pool = ThreadPoolExecutor(max_workers=concurrency) if concurrency > 1 else None
    try:
        for pdf in batches:
            pairs = list(zip(pdf["url"], pdf["stored_name"]))
            results = list(pool.map(one, pairs)) if pool else [one(p) for p in pairs]
            done = [r[3] for r in results]
            yield pd.DataFrame({
                "row_no": pdf["row_no"], "url": pdf["url"], "stored_name": pdf["stored_name"],
                "outcome": [r[0] for r in results], "message": [r[1] for r in results],
                "bytes_written": pd.array([r[2] for r in results], dtype="Int64"),
                "finished_at": pd.Series(pd.to_datetime(done), dtype="datetime64[us]"),
            })
    finally:
        if pool:
            pool.shutdown(wait=False)


# C4
def fetch_documents(rows: DataFrame, url_col: str = "pdf_url", dest: str | None = None,
                    signature: bytes = S.PDF_SIGNATURE, timeout: float = 10.0,
                    num_partitions: int | None = None, name_col: str = "stored_name",
                    concurrency: int = 8, host_slots: int | None = None) -> DataFrame:
    """Open each row's URL, test the first bytes against ``signature``, and (when
    ``dest`` is given) store the body as ``dest/<stored_name>``. ``dest=None``
    only probes. Returns ``row_no, url, stored_name, outcome, message,
    bytes_written, finished_at``; every error is a ``failed`` outcome with its text.

    Open connections = ``num_partitions`` running tasks x ``concurrency`` threads
    per task (downloads wait on the network, not the CPU).

    ``host_slots`` bounds the load on any one server: rows are partitioned on
    (URL host, hash(row_no) mod ``host_slots``), so one host's URLs go to at most
    ``host_slots`` tasks (at most ``host_slots x concurrency`` connections) while
    a host holding many URLs is still spread over that many tasks."""
    src = rows.select(F.col("row_no").cast("long").alias("row_no"),
                      F.col(url_col).alias("url"), F.col(name_col).alias("stored_name"))
    n = num_partitions or rows.sparkSession.sparkContext.defaultParallelism
    if host_slots:
        host = F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit(""))
        slot = F.pmod(F.xxhash64("row_no"), F.lit(int(host_slots)))
        src = src.repartition(n, host, slot)
    else:
        src = src.repartition(n, "row_no")
    sig, d, to, cc = bytes(signature), dest, float(timeout), int(concurrency)
    if d is not None:
        d = prepare_folder(d)
    return src.mapInPandas(lambda it: _fetch_batches(it, sig, d, to, cc), FETCH_OUT)


def prepare_folder(dest: str) -> str:
    """The OS path of the target folder, created if absent. Executors write it
    with POSIX calls, so a folder on another store is refused before any fetch."""
    import os
    import re

    from docfetch.session import to_local_path

    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://", dest) and not dest.startswith("file://"):
        raise ValueError(f"target folder must be a mounted path, not {dest}")
    path = to_local_path(dest)
    os.makedirs(path, exist_ok=True)
    return path


# C5
def check_signature(df: DataFrame, content_col: str = "content",
                    signature: bytes = S.PDF_SIGNATURE, flag: str = "signature_ok") -> DataFrame:
    """Does the body start with ``signature``? Works on a BINARY column (first
    bytes compared) or a STRING column (a text body starts with an ASCII
    signature exactly when its UTF-8 bytes do). NULL body = False."""
    c = F.col(content_col)
    dtype = dict(df.dtypes)[content_col]
    if dtype == "binary":
        test: Column = F.substring(c, 1, len(signature)) == F.lit(bytearray(signature))
    else:
        test = c.startswith(signature.decode("ascii"))
    return df.withColumn(flag, F.coalesce(test, F.lit(False)))


def signature_outcome(df: DataFrame, flag: str = "signature_ok") -> DataFrame:
    """``outcome`` / ``message`` from a signature flag (as a fetch would)."""
    return (df.withColumn("outcome", F.when(F.col(flag), "successful").otherwise("failed"))
            .withColumn("message", F.when(F.col(flag), F.lit(S.MSG_DOWNLOADED))
                        .otherwise(F.lit(S.MSG_NOT_PDF))))


# C6
def last_attempt_per_row(attempts: DataFrame, key: str = "row_no", attempt: str = "attempt") -> DataFrame:
    """Keep the highest ``attempt`` per ``key`` (the backup's result replaces the
    primary's). max-aggregate + semi-join on (key, attempt): no window over a
    hot key."""
    from docfetch.operators.keys import keep_extreme_per_key
    return keep_extreme_per_key(attempts, [key], attempt, last=True)


def share_downloads(rows: DataFrame, done: DataFrame, url_col: str = "pdf_url",
                    name_col: str = "stored_name") -> tuple[DataFrame, DataFrame]:
    """``rows`` whose URL a successful attempt of ``done`` stored under the same name share
    that attempt: the first result is their attempts (``done``'s columns), the second the
    rows that are still to be fetched. A body that many rows name is so downloaded once,
    not once a row; where the download failed, every row makes its own attempt."""
    from docfetch.operators.keys import keep_extreme_per_key

    one = keep_extreme_per_key(done.where(F.col("outcome") == "successful"), ["url", "stored_name"], "row_no")
    one = one.select(F.col("url").alias("_url"), F.col("stored_name").alias("_name"),
                     *[c for c in done.columns if c not in ("row_no", "url", "stored_name")])
    same = (F.col(url_col) == F.col("_url")) & (F.col(name_col) == F.col("_name"))
    asked = rows.select(F.col("row_no").cast("long").alias("row_no"), F.col(url_col), F.col(name_col))
    own = {"url": "_url", "stored_name": "_name"}
    shared = asked.join(one, same).select(*[F.col(own.get(c, c)).alias(c) for c in done.columns])
    return shared, rows.join(one.select("_url", "_name"), same, "left_anti")


def fetch_with_backup(rows: DataFrame, primary: str = "pdf_url", backup: str = "pdf_backup_url",
                      dest: str | None = None, signature: bytes = S.PDF_SIGNATURE,
                      timeout: float = 10.0, num_partitions: int | None = None,
                      persist=None, concurrency: int = 8, host_slots: int | None = None,
                      first: DataFrame | None = None, files: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Pass 1 on ``primary``; rows that failed are tried on ``backup`` (stored under
    the backup URL's own name); all attempts are returned with ``attempt`` 1/2.

    ``first`` are the rows' first attempts if a run has made them already (a run plans
    them and fetches in waves). ``files`` is the listing of ``dest``: a backup whose file is
    there counts as already downloaded, at ``now``. ``persist`` (DataFrame -> DataFrame)
    materialises a pass before its result is read, so no fetch is ever run twice; it
    defaults to ``persist_attempts``. Rows of one URL and stored name share its download
    (``share_downloads``).
    """
    from docfetch.functions.columns import base_name, stored_name
    from docfetch.operators.keys import flag_extreme_per_key

    persist = persist or persist_attempts

    def fetch_rows(df: DataFrame, url_col: str, attempt: int) -> DataFrame:
        return persist(fetch_documents(df, url_col, dest, signature, timeout, num_partitions, concurrency=concurrency,
                                       host_slots=host_slots).withColumn("attempt", F.lit(attempt)))

    def fetch(df: DataFrame, url_col: str, attempt: int) -> DataFrame:
        if dest is None:                  # only the first bytes are read: nothing to share
            return fetch_rows(df, url_col, attempt)
        df = flag_extreme_per_key(df, [url_col, "stored_name"], "row_no", "_first")
        once = fetch_rows(df.where("_first"), url_col, attempt)
        shared, others = share_downloads(df.where("not _first"), once, url_col)
        return once.unionByName(shared).unionByName(fetch_rows(others, url_col, attempt))

    if first is None:
        first = fetch(rows.select("row_no", primary, stored_name(base_name(primary)).alias("stored_name")), primary, 1)
    # no backup URL (NULL, or '' from a missing column) means no second attempt
    retry = (rows.select("row_no", backup).where(F.col(backup).isNotNull() & (F.col(backup) != ""))
             .join(first.where(F.col("outcome") == "failed").select("row_no"), "row_no", "left_semi")
             .withColumn("file_name", base_name(backup)).withColumn("stored_name", stored_name("file_name")))
    if files is None:
        return first.unionByName(fetch(retry.drop("file_name"), backup, 2), allowMissingColumns=True)
    from docfetch.plans.fetch_plan import mark_existing_files

    retry = mark_existing_files(retry, files)
    there = retry.where("in_folder").select(
        "row_no", F.lit(2).alias("attempt"), F.col(backup).alias("url"), F.col("file_name").alias("stored_name"),
        F.lit(dest).alias("file_folder"), F.lit("already_downloaded").alias("outcome"),
        F.lit(S.MSG_EXISTS_IN_FOLDER).alias("message"), (now if now is not None else F.lit(None).cast("timestamp_ntz")).alias("finished_at"))
    second = fetch(retry.where(~F.col("in_folder")).select("row_no", backup, "stored_name"), backup, 2)
    second = second.withColumn("file_folder", F.lit(dest)).select(*there.columns)
    return first.unionByName(there.unionByName(second).select(*first.columns))


def persist_attempts(df: DataFrame) -> DataFrame:
    """Write attempts once to a fresh folder under the shared checkpoint root and
    read them back: lineage is cut, and no later action re-runs a fetch."""
    from docfetch.session import scratch_path

    path = scratch_path(df.sparkSession, "attempts")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
