"""Manifest readers (A1 CSV, A2 XLSX) that keep each row's position in its file.

``row_no`` (0-based data row, header excluded) is set at the scan, before any
shuffle, without a window over a whole file: every input split is numbered
locally (``monotonically_increasing_id`` is consecutive inside a task), the
per-split row counts - one row per split, a table bounded by the number of
input splits - give each split its starting offset within its file, and a join
on (file, split start) adds it. CSV files whose cells may hold newlines are cut
the same way, with the quote state of each split (``sources.csv_lines``).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfetch import schemas as S
from docfetch.sources.csv_lines import parse_rows, read_rows
from docfetch.sources.workbooks import CELLS_SCHEMA, WORKBOOK_EXTENSIONS, WorkbookSource, parse_contents


def number_rows(df: DataFrame, file_col: str = "source_file", start_col: str = "_split_start",
                out: str = "row_no") -> DataFrame:
    """Add ``out`` = position of the row within its file. ``df`` must come straight
    from a file scan and carry ``file_col`` and ``start_col`` (from ``_metadata``)."""
    x = df.withColumn("_mid", F.monotonically_increasing_id())
    splits = x.groupBy(file_col, start_col).agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(file_col).orderBy(start_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(file_col, start_col, "_m0",
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    return (x.join(offsets, [file_col, start_col])
            .withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long"))
            .drop("_mid", "_m0", "_off", start_col))


# A1
def read_manifest_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None,
                      multi_line: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """CSV manifests: first line is the header, every cell is text, an empty cell
    is NULL, a short row has NULLs at the end, extra cells are dropped.

    Without ``schema`` the column names come from the header (all STRING).
    ``multi_line`` keeps quoted newlines inside a cell. Either way a file is cut
    into splits read by many tasks; ``multi_line=False`` reads it once instead of
    twice, if no cell holds a newline."""
    reader = (spark.read.option("header", True).option("multiLine", multi_line)
              .option("escape", '"').option("mode", "PERMISSIVE").option("encoding", encoding))
    if multi_line:
        names = schema or reader.csv(path if isinstance(path, str) else list(path)).schema
        return parse_rows(read_rows(spark, path, encoding), names)
    if schema is not None:
        reader = reader.schema(schema)
    raw = reader.csv(path if isinstance(path, str) else list(path))
    cols = list(raw.columns)
    df = raw.select(*[F.col(f"`{c}`") for c in cols],
                    F.col("_metadata.file_path").alias("source_file"),
                    F.col("_metadata.file_block_start").alias("_split_start"))
    return number_rows(df).select("source_file", "row_no", *[F.col(f"`{c}`") for c in cols])


# A2
def read_manifest_xlsx(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Workbooks (first row = header, active sheet only) as ``source_file, row_no,
    cells MAP<header, text>, read_error``. Each workbook is a partition of the scan
    (a zip cannot be split) and its rows are handed over as they are parsed, so a
    task's memory does not grow with the workbook.

    Files that executors can open (a mounted folder) are read in place; from other
    stores Spark hands a workbook over as one value (2 GB at most)."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path if isinstance(path, str) else list(path)).select("path", "content")
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    files = files.where(ext.isin(*WORKBOOK_EXTENSIONS))
    paths = [r["path"] for r in files.select("path").collect()]      # names only, as any scan lists its files
    if paths and all(p.startswith("file:") for p in paths):
        spark.dataSource.register(WorkbookSource)
        return spark.read.format(WorkbookSource.name()).option("paths", json.dumps(sorted(paths))).load()
    return files.mapInArrow(parse_contents, CELLS_SCHEMA)


def expand_cells(df: DataFrame, mapping=S.MANIFEST_COLUMN_MAP, default: str | None = "",
                 keep: Sequence[str] = ("source_file", "row_no"),
                 required: Sequence[str] | None = None) -> DataFrame:
    """B2 for workbook rows: header present in that workbook -> its cell (NULL
    when empty), header absent -> ``default``. With ``required``, also
    ``missing_columns``: the required headers that row's workbook lacks."""
    cols = [F.col(k) for k in keep if k in df.columns]
    for src, dst in mapping.items():
        cols.append(F.when(F.map_contains_key("cells", F.lit(src)), F.try_element_at("cells", F.lit(src)))
                    .otherwise(F.lit(default)).alias(dst))
    if "read_error" in df.columns:
        cols.append(F.col("read_error"))
    if required:
        checks = [F.when(~F.map_contains_key("cells", F.lit(h)), F.lit(h)) for h in required]
        missing = F.array_compact(F.array(*checks))
        if "read_error" in df.columns:  # an unreadable file reports only that
            missing = F.when(F.col("read_error").isNull(), missing).otherwise(F.array().cast("array<string>"))
        cols.append(missing.alias("missing_columns"))
    return df.select(*cols)


def unique_positions(df: DataFrame) -> DataFrame:
    """Make ``row_no`` unique across files (``file_row_no`` keeps the position in
    the file): files are ranked by path and each file's positions are shifted past
    the largest of the files before it. The window runs over one row per file.
    Rows without a position (-1: an unreadable file) keep it."""
    per_file = df.groupBy("source_file").agg(F.greatest(F.max("row_no") + 1, F.lit(0)).alias("_n"))
    earlier = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_file.select(F.col("source_file").alias("_file"),
                              F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    shifted = F.when(F.col("row_no") >= 0, F.col("row_no") + F.col("_off")).otherwise(F.col("row_no"))
    return (df.join(offsets, F.col("source_file") == F.col("_file"))
            .withColumn("file_row_no", F.col("row_no")).withColumn("row_no", shifted).drop("_file", "_off"))


def read_manifests(spark: SparkSession, paths: Sequence[str], multi_line: bool = True,
                   encoding: str = "UTF-8") -> DataFrame:
    """Mapped manifest rows (B2 names) of CSV files (or folders of part files) and
    workbooks, each with its own header, plus ``missing_columns``: the required
    headers the row's file lacks (such rows are for rejection, not for an error
    that stops a run). ``row_no`` is unique over all files, ``file_row_no`` the
    position in the file. Files with equal headers are read in one scan.
    ``multi_line`` and ``encoding`` are those of ``read_manifest_csv``."""
    from docfetch.operators.prepare import map_columns

    csvs = [p for p in paths if p.lower().endswith(".csv")]
    books = [p for p in paths if p.lower().endswith(WORKBOOK_EXTENSIONS)]
    parts = []
    same_header: dict[tuple[str, ...], list[str]] = {}
    for p in csvs:  # each CSV has its own header (its first line)
        header = tuple(spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
                       .option("encoding", encoding).csv(p).columns)
        same_header.setdefault(header, []).append(p)
    for group in same_header.values():
        raw = read_manifest_csv(spark, group, multi_line=multi_line, encoding=encoding)
        lacking = [h for h in S.REQUIRED_MANIFEST_COLUMNS if h not in raw.columns]
        parts.append(map_columns(raw).withColumn(
            "missing_columns", F.array(*[F.lit(h) for h in lacking]).cast("array<string>"))
            .withColumn("read_error", F.lit(None).cast("string")))
    if books:
        parts.append(expand_cells(read_manifest_xlsx(spark, books), required=S.REQUIRED_MANIFEST_COLUMNS))
    if not parts:
        raise ValueError("no CSV or workbook among the given paths")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return unique_positions(out)
