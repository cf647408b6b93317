"""Stored files, catalog tables and exports (A3-A5, A7)."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfetch import schemas as S

LISTING_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), True),
    T.StructField("file_folder", T.StringType(), True),
    T.StructField("file_name", T.StringType(), True),
    T.StructField("length", T.LongType(), True),
    T.StructField("modificationTime", T.TimestampType(), True),
])


def read_if_exists(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame | None:
    """A Parquet table, or None when there is nothing at ``path`` yet. Any other
    failure (permissions, a broken store) is raised: it must not look like an
    empty table."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path): driver-side calls on any store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


PART_NAME = r"^\.docfetch-[0-9a-f]{32}\.part$"    # the fetcher's files in progress


# A3
def list_stored_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Regular files of ``folder`` as ``path, file_folder, file_name, length,
    modificationTime``. The ``content`` column is never selected, so no file is
    read. Spark's listing hides names starting with ``.`` or ``_``; those (few)
    are listed by the file system itself and added, without the fetcher's files
    in progress. With ``recursive`` hidden names count in the top folder only.

    ``file_folder`` is ``folder`` exactly as given (the form the catalog stores
    after a run into that folder); with ``recursive`` it is each file's parent
    path, without a ``file:`` scheme."""
    try:
        df = (spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
              .load(folder).select("path", "length", "modificationTime"))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        df = spark.createDataFrame([], "path string, length long, modificationTime timestamp")
    hidden = _hidden_files(spark, folder)
    if hidden:
        df = df.unionByName(spark.createDataFrame(hidden, "path string, length long, millis long")
                            .select("path", "length", F.timestamp_millis("millis").alias("modificationTime")))
    name = F.substring_index("path", "/", -1)
    if recursive:
        parent = F.regexp_replace(F.regexp_replace("path", "/[^/]*$", ""), "^file:", "")
    else:
        parent = F.lit(folder.rstrip("/") or "/")
    return df.select("path", parent.alias("file_folder"), name.alias("file_name"),
                     "length", "modificationTime")


def _hidden_files(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    fs, pattern = _file_system(spark, folder.rstrip("/") + "/[._]*")
    out = []
    for status in fs.globStatus(pattern) or []:
        name = status.getPath().getName()
        shown = name.startswith("_") and "=" in name or name.startswith(("_metadata", "_common_metadata"))
        if status.isFile() and not shown and not re.match(PART_NAME, name) and not name.endswith(".crc"):
            out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return out


# A4
def read_catalog(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.schema(S.CATALOG_SCHEMA).parquet(location)


def read_catalog_jdbc(spark: SparkSession, url: str, table: str, partition_column: str = "id",
                      lower_bound: int | None = None, upper_bound: int | None = None,
                      num_partitions: int = 8, **options: str) -> DataFrame:
    """Parallel JDBC read: ``num_partitions`` range queries on ``partition_column``
    (bounds only split the range, they do not filter). Filters and projections
    on the result are pushed into the database's SQL."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if lower_bound is not None and upper_bound is not None:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower_bound)).option("upperBound", str(upper_bound))
                  .option("numPartitions", str(num_partitions)))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


# A5
def _python_text(c: Column, dtype: str) -> Column:
    """How ``str(value)`` prints a value (NULL -> ``None``)."""
    if dtype.startswith("timestamp"):
        base = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(c, "SSSSSS")
        txt = F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))
    elif dtype == "boolean":
        txt = F.when(c, "True").otherwise("False")
    else:
        txt = c.cast("string")
    return F.coalesce(txt, F.lit("None"))


def compat_lines(df: DataFrame) -> DataFrame:
    """Export rows as the original wrote them: values joined by ``,`` with no
    quoting, NULL printed as ``None``. One ``value`` column per line."""
    return df.select(F.concat_ws(",", *[_python_text(F.col(c), t) for c, t in df.dtypes]).alias("value"))


def export_csv(df: DataFrame, path: str, compat: bool = False, mode: str = "errorifexists") -> str:
    """Write ``df`` as CSV part files (in parallel). Default: header, quoted
    fields, embedded quotes doubled - safe for commas and newlines. ``compat``:
    the original's unquoted layout, written as ``path/header`` (one line) and
    ``path/body`` (data lines); concatenated in that order they form the file."""
    if not compat:
        (df.write.mode(mode).option("header", True).option("escape", '"')
         .option("quoteAll", False).csv(path))
        return path
    spark = df.sparkSession
    spark.createDataFrame([(",".join(df.columns),)], "value string").coalesce(1) \
        .write.mode(mode).text(f"{path}/header")
    compat_lines(df).write.mode(mode).text(f"{path}/body")
    return path


# A7
class VersionConflict(RuntimeError):
    """Another writer committed this version number first."""


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it exists; False when it does. The store decides
    (``create`` without overwrite), so of two writers one gets True."""
    fs, p = _file_system(spark, path)
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_text_file(spark: SparkSession, path: str) -> str | None:
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a small folder (none if it does not exist)."""
    fs, p = _file_system(spark, folder)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def remove_tree(spark: SparkSession, path: str) -> None:
    """Remove a file or folder that this library wrote and nothing refers to any more."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def _version_file(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/versions/{number:012d}.json"


def save_table(df: DataFrame, root: str, bucket_by: str | None = None, num_buckets: int = 0,
               expected: int | None = None, note: str | None = None) -> str:
    """Write the next version of a table under ``root/data/<uuid>`` - a fresh
    folder, never the one being read (Spark would delete its own input) - and
    commit it by creating ``root/versions/<number>.json``. Returns the data path.

    ``expected`` is the version number ``df`` was computed from (0: none): when
    another writer has committed in between, ``VersionConflict`` is raised and
    nothing changes (``update_table`` retries). ``note`` is kept in the commit.

    With ``bucket_by`` the rows are range-partitioned on that key and sorted
    within each file, so files cover disjoint key ranges and key look-ups prune
    on Parquet min/max statistics. Without ``num_buckets`` AQE sizes the ranges
    to ``spark.sql.adaptive.advisoryPartitionSizeInBytes``."""
    spark = df.sparkSession
    number = (latest_commit(spark, root)[0] if expected is None else expected) + 1
    path = f"{root.rstrip('/')}/data/v={number:012d}-{uuid.uuid4().hex[:8]}"
    out = df
    if bucket_by:
        out = out.repartitionByRange(num_buckets, bucket_by) if num_buckets else out.repartitionByRange(bucket_by)
        out = out.sortWithinPartitions(bucket_by)
    out.write.parquet(path)
    if note is not None:
        write_note(spark, root, note, number)
    if not create_if_absent(spark, _version_file(root, number), json.dumps({"path": path, "note": note})):
        raise VersionConflict(f"{root}: version {number} exists")
    return path


def update_table(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], schema: T.StructType,
                 bucket_by: str | None = None, note: str | None = None) -> str:
    """Commit ``change(latest version)``; when another writer was first, apply the
    change again to the version it wrote (each conflict means that one got on)."""
    while True:
        number, path, _ = latest_commit(spark, root)
        base = spark.createDataFrame([], schema) if path is None else spark.read.schema(schema).parquet(path)
        try:
            return save_table(change(base), root, bucket_by, expected=number, note=note)
        except VersionConflict:
            continue


def latest_commit(spark: SparkSession, root: str) -> tuple[int, str | None, str | None]:
    """(number, data path, note) of the newest version; (0, None, None) for none."""
    fs, folder = _file_system(spark, f"{root.rstrip('/')}/versions")
    if not fs.exists(folder):
        return 0, None, None
    numbers = [int(s.getPath().getName()[:12]) for s in fs.listStatus(folder)
               if re.match(r"^\d{12}\.json$", s.getPath().getName())]
    if not numbers:
        return 0, None, None
    commit = json.loads(read_text_file(spark, _version_file(root, max(numbers))))
    return max(numbers), commit.get("path"), commit["note"]


def _note_file(root: str, note: str) -> str:
    return f"{root.rstrip('/')}/notes/{hashlib.sha256(note.encode()).hexdigest()}.json"


def write_note(spark: SparkSession, root: str, note: str, number: int) -> None:
    """Before version ``number`` is committed with this note: where to look for it later."""
    fs, p = _file_system(spark, _note_file(root, note))
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps({"note": note, "number": number}).encode()))
    finally:
        out.close()


def is_committed(spark: SparkSession, root: str, note: str) -> bool:
    """Was a version with this note committed, however long ago? The note's own file names
    the version tried last; whether it was committed shows in that version. A note has one
    writer at a time (a task's id)."""
    said = read_text_file(spark, _note_file(root, note))
    text = said and read_text_file(spark, _version_file(root, json.loads(said)["number"]))
    return bool(text) and json.loads(text)["note"] == note


def latest_version(spark: SparkSession, root: str) -> str | None:
    """Path of the newest complete version (committed after its data)."""
    return latest_commit(spark, root)[1]


def read_latest(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The newest version's rows, of a table of full versions; None if there is none."""
    path = latest_version(spark, root)
    if path is None:
        return None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)
