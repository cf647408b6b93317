"""A versioned table kept as a log: base files by key range, and small deltas on top (A7, D1, D4).

A commit ``versions/<number>.json`` (created only if absent, as for full versions) lists

* ``ranges`` - folders of rows sorted by key, each from its ``low`` key up to the next one's;
* ``deltas`` - folders of rows written since, oldest first: a row replaces the base row of
  its key, or removes it (``_deleted``); a delta holds a key once;
* ``max_id`` - the greatest surrogate id given so far, so that no commit looks for it.

An upsert of k keys reads the ranges that can hold them and writes one delta of k rows; no
file of the table is rewritten. A read takes the newest delta row of each key and the base
rows of all other keys: an anti join of two sides that hold a key once, the smaller of which
is broadcast when its size allows. ``merge`` folds the deltas into the ranges they touch,
rewriting only those, and cuts a range that has grown.

Files are never changed or removed once committed, so a reader of an older version, or a
task that is run again, finds what it began with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfetch.operators import catalog as CA
from docfetch.operators.keys import keep_extreme_per_key
from docfetch.sources import tables as TB

DELETED = "_deleted"
EMPTY = {"ranges": [], "deltas": [], "max_id": 0, "note": None}


def read_commit(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict]:
    """(number, commit) of a version, by default the newest; (0, an empty table) for none."""
    number = TB.latest_commit(spark, root)[0] if version is None else version
    if not number:
        return 0, dict(EMPTY)
    commit = json.loads(TB.read_text_file(spark, TB._version_file(root, number)))
    if "path" in commit:                            # a full version (``save_table``): one range
        commit = {**EMPTY, "ranges": [{"path": commit["path"], "low": "", "rows": 0}], "max_id": None,
                  "note": commit["note"]}
    return number, commit


def read(spark: SparkSession, root: str, schema: T.StructType, key: str = "brnumber", version: int | None = None,
         low: str | None = None, high: str | None = None) -> DataFrame:
    """The rows of a version; with ``low`` and ``high`` only from the ranges that can hold
    keys between them (other keys may be among the rows)."""
    return _rows(spark, read_commit(spark, root, version)[1], schema, key, low, high)


def create(spark: SparkSession, root: str, rows: DataFrame, key: str = "brnumber", id_col: str = "id",
           range_rows: int = 1_000_000, note: str | None = None) -> int:
    """The table's first version, from rows unique on ``key``."""
    path = _new_path(root)
    _write_ranges(rows.withColumn("_range", F.lit(0)), path, key, max(1, -(-rows.count() // range_rows)))
    ranges = _ranges_of(spark, path, key)
    max_id = spark.read.schema(rows.schema).parquet(path).agg(F.max(id_col)).first()[0] if ranges else 0
    commit = {**EMPTY, "ranges": ranges, "max_id": max_id or 0, "note": note}
    if not _commit(spark, root, 1, commit):
        raise TB.VersionConflict(f"{root}: the table exists")
    return 1


def upsert(spark: SparkSession, root: str, updates: DataFrame, schema: T.StructType, key: str = "brnumber",
           order: str = "row_no", id_col: str = "id", note: str | None = None, merge_after: int = 16,
           range_rows: int = 1_000_000) -> int:
    """D1 as one delta: a known key keeps its id and the columns the update does not carry,
    a new key gets a fresh id. When another writer was first, the rows are worked out again
    from its version. After ``merge_after`` deltas they are merged. Returns the version.

    ``updates`` may be read more than once: pass rows already stored."""
    updates = CA.latest_per_key(updates, key, order)

    def delta(commit: dict) -> DataFrame:
        known = _known(spark, commit, updates.select(key), schema, key)
        return CA.upsert(known, updates, key, order, id_col, max_id=commit["max_id"]).withColumn(DELETED, F.lit(False))

    return _append(spark, root, delta, schema, key, id_col, note, merge_after, range_rows)


def delete(spark: SparkSession, root: str, keys: DataFrame, schema: T.StructType, key: str = "brnumber",
           id_col: str = "id", note: str | None = None, merge_after: int = 16, range_rows: int = 1_000_000) -> int:
    """D4 as one delta of the deleted keys; keys that the table lacks write nothing."""
    keys = keys.select(key).where(F.col(key).isNotNull()).distinct()

    def delta(commit: dict) -> DataFrame:
        return _known(spark, commit, keys, schema, key).withColumn(DELETED, F.lit(True))

    return _append(spark, root, delta, schema, key, id_col, note, merge_after, range_rows)


def merge(spark: SparkSession, root: str, schema: T.StructType, key: str = "brnumber",
          range_rows: int = 1_000_000) -> int:
    """Fold the deltas into the ranges their keys lie in; other ranges stay as they are.
    Deltas that others commit meanwhile are kept on top. Returns the version."""
    number, commit = read_commit(spark, root)
    if not commit["deltas"]:
        return number
    newest = _newest(spark, commit, schema, key)
    lows = [r["low"] for r in commit["ranges"]]
    in_range = newest.select(key).mapInArrow(_range_numbers(lows, key, only=True), "_range long").distinct()
    touched = {r["_range"] for r in in_range.collect()}                 # at most as many as there are ranges
    old = [r for i, r in enumerate(commit["ranges"]) if i in touched]
    base = _base(spark, old, schema)
    rows = (base.join(newest.select(key), key, "left_anti").select(*schema.fieldNames())
            .unionByName(newest.where(~F.col(DELETED)).select(*schema.fieldNames())))
    numbered = T.StructType(list(schema.fields) + [T.StructField("_range", T.LongType())])
    path = _new_path(root)
    n_rows = sum(r["rows"] for r in old) + sum(d["rows"] for d in commit["deltas"])
    _write_ranges(rows.mapInArrow(_range_numbers(lows, key), numbered), path, key, max(1, -(-n_rows // range_rows)))
    new = _ranges_of(spark, path, key)
    kept = [r for i, r in enumerate(commit["ranges"]) if i not in touched]
    ranges = sorted(kept + new, key=lambda r: r["low"])
    while True:
        latest, now = read_commit(spark, root)
        if now["ranges"] != commit["ranges"] or now["deltas"][:len(commit["deltas"])] != commit["deltas"]:
            return latest                                               # another merge was first: its version stands
        later = now["deltas"][len(commit["deltas"]):]
        if _commit(spark, root, latest + 1, {**now, "ranges": ranges, "deltas": later, "note": None}):
            return latest + 1


# --- reading -----------------------------------------------------------------------

def _base(spark: SparkSession, ranges: list[dict], schema: T.StructType) -> DataFrame:
    paths = [r["path"] for r in ranges]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _newest(spark: SparkSession, commit: dict, schema: T.StructType, key: str) -> DataFrame:
    """The newest delta row of each key."""
    with_mark = T.StructType(list(schema.fields) + [T.StructField(DELETED, T.BooleanType())])
    parts = [spark.read.schema(with_mark).parquet(d["path"]).withColumn("_seq", F.lit(i))
             for i, d in enumerate(commit["deltas"])]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return (keep_extreme_per_key(out, [key], "_seq", last=True) if len(parts) > 1 else out).drop("_seq")


def _rows(spark: SparkSession, commit: dict, schema: T.StructType, key: str, low: str | None = None,
          high: str | None = None) -> DataFrame:
    base = _base(spark, _holding(commit["ranges"], low, high), schema)
    if not commit["deltas"]:
        return base
    newest = _newest(spark, commit, schema, key)
    names = schema.fieldNames()
    return (base.join(newest.select(key), key, "left_anti").select(*names)
            .unionByName(newest.where(~F.col(DELETED)).select(*names)))


def _holding(ranges: list[dict], low: str | None, high: str | None) -> list[dict]:
    """The ranges that can hold a key from low to high."""
    ends = [r["low"] for r in ranges[1:]] + [None]
    return [r for r, end in zip(ranges, ends)
            if (high is None or r["low"] <= high) and (low is None or end is None or end > low)]


def _known(spark: SparkSession, commit: dict, keys: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    """The table's rows of these keys."""
    low = high = None
    if len(commit["ranges"]) > 1:
        low, high = keys.agg(F.min(key), F.max(key)).first()
    return _rows(spark, commit, schema, key, low, high).join(keys, key, "left_semi").select(*schema.fieldNames())


# --- writing -----------------------------------------------------------------------

def _new_path(root: str) -> str:
    return f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"


def _commit(spark: SparkSession, root: str, number: int, commit: dict) -> bool:
    if commit["note"] is not None:
        TB.write_note(spark, root, commit["note"], number)
    return TB.create_if_absent(spark, TB._version_file(root, number), json.dumps(commit))


def _append(spark: SparkSession, root: str, delta: Callable[[dict], DataFrame], schema: T.StructType, key: str,
            id_col: str, note: str | None, merge_after: int, range_rows: int) -> int:
    while True:                                     # a conflict means that another writer got on
        number, commit = read_commit(spark, root)
        if commit["max_id"] is None:
            commit["max_id"] = _base(spark, commit["ranges"], schema).agg(F.max(id_col)).first()[0] or 0
        path = _new_path(root)
        delta(commit).select(*schema.fieldNames(), DELETED).write.parquet(path)
        rows, max_id = spark.read.schema(schema).parquet(path).agg(F.count(F.lit(1)), F.max(id_col)).first()
        deltas = commit["deltas"] + ([{"path": path, "rows": rows}] if rows else [])
        new = {**commit, "deltas": deltas, "max_id": max(commit["max_id"], max_id or 0), "note": note}
        if _commit(spark, root, number + 1, new):
            break
    if len(deltas) >= merge_after:
        return merge(spark, root, schema, key, range_rows)
    return number + 1


def _write_ranges(rows: DataFrame, path: str, key: str, pieces: int) -> None:
    """A folder per old range and piece of it, sorted by key."""
    (rows.repartitionByRange(pieces, "_range", key).sortWithinPartitions("_range", key)
     .withColumn("_piece", F.spark_partition_id()).write.partitionBy("_range", "_piece").parquet(path))


def _ranges_of(spark: SparkSession, path: str, key: str) -> list[dict]:
    """The folders just written: a row each."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("_range", T.LongType()),
                           T.StructField("_piece", T.LongType())])
    found = (spark.read.schema(schema).parquet(path).groupBy("_range", "_piece")
             .agg(F.min(key).alias("low"), F.count(F.lit(1)).alias("rows")).collect())
    return [{"path": f"{path}/_range={r['_range']}/_piece={r['_piece']}", "low": r["low"], "rows": r["rows"]}
            for r in sorted(found, key=lambda r: r["low"])]


def _range_numbers(lows: list[str], key: str, only: bool = False) -> Callable:
    """Each row's range: the last one that begins at its key or before it (else the first)."""
    def number(batches):
        from bisect import bisect_right

        import pyarrow as pa

        for batch in batches:
            of = pa.array([max(bisect_right(lows, k) - 1, 0) for k in batch[key].to_pylist()], pa.int64())
            names = [] if only else batch.schema.names
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), of], names=[*names, "_range"])

    return number
