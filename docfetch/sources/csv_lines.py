"""One CSV file with quoted newlines, read by many tasks.

A file is cut into physical lines, as text files are: any task can begin at a line. Whether
a line begins a row depends on all quotes before it, which a task does not know; so each
task follows both cases, "the range begins outside a quoted cell" and "... inside one",
and counts the rows that begin under each. A byte range then is a function from the
state at its begin to the state at its end, and its number of rows. Composing these
functions along the file (one row per range, not per line) tells every range which case
holds and how many rows precede it.

Lines that are a row by themselves are parsed where they are read. Only the lines of rows
that go over several lines are shuffled, to be put together.

A quote opens a cell only at the cell's begin and a doubled quote inside is a quote, as in
Spark's own CSV reader; stray quotes elsewhere are text. Empty lines between rows are
skipped and have no position.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIP, ROW, PART = 0, 1, 2        # an empty line; a whole row; a part of one
LINES_SCHEMA = ("source_file string, split long, line long, value string, "
                "rows_out long, rows_in long, kind_out int, kind_in int, end_out boolean, end_in boolean")


def state_after(line: str, inside: bool, delimiter: str = ",", quote: str = '"') -> bool:
    """Is the end of the line inside a quoted cell, if its begin is (or is not)?"""
    at = 0
    while True:
        if inside:
            at = line.find(quote, at)
            if at < 0:
                return True
            if line.startswith(quote, at + 1):
                at += 2
                continue
            inside, at = False, at + 1
        elif line.startswith(quote, at):
            inside, at = True, at + 1
            continue
        at = line.find(delimiter, at) + 1           # the cell's end
        if at == 0:
            return False


def _follow(lines: list[str], inside: bool, count: int) -> tuple[list[int], list[int], list[bool]]:
    """Per line: rows begun so far, kind, and the state at its end."""
    rows, kinds, ends = [], [], []
    for line in lines:
        before = inside
        if '"' in line:
            inside = state_after(line, inside)
        if before:
            kind = PART
        elif line in ("", "\r"):
            kind = SKIP
        else:
            kind = PART if inside else ROW
            count += 1
        rows.append(count)
        kinds.append(kind)
        ends.append(inside)
    return rows, kinds, ends


def _scan(batches: Iterator) -> Iterator:
    import pyarrow as pa

    place, held = None, None        # the range being read; (next line, rows and state of both cases)
    for batch in batches:
        files, splits = batch["source_file"].to_pylist(), batch["split"].to_pylist()
        values = batch["value"].to_pylist()
        cuts = [i for i in range(len(files)) if i == 0 or (files[i], splits[i]) != (files[i - 1], splits[i - 1])]
        for a, b in zip(cuts, [*cuts[1:], len(files)]):
            if (files[a], splits[a]) != place:
                place, held = (files[a], splits[a]), (0, 0, False, 0, True)
            line, n_out, s_out, n_in, s_in = held
            lines = values[a:b]
            if line == 0 and splits[a] == 0:
                lines[0] = lines[0].removeprefix("﻿")
            out, inn = _follow(lines, s_out, n_out), _follow(lines, s_in, n_in)
            held = (line + len(lines), out[0][-1], out[2][-1], inn[0][-1], inn[2][-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(files[a:b]), pa.array(splits[a:b], pa.int64()),
                 pa.array(range(line, line + len(lines)), pa.int64()), pa.array(lines, pa.string()),
                 pa.array(out[0], pa.int64()), pa.array(inn[0], pa.int64()), pa.array(out[1], pa.int32()),
                 pa.array(inn[1], pa.int32()), pa.array(out[2]), pa.array(inn[2])],
                names=[c.split()[0] for c in LINES_SCHEMA.split(", ")])


def range_states(lines: DataFrame) -> DataFrame:
    """Per byte range of a file: does it begin inside a cell, and how many rows precede it?

    A range's function is the identity, the swap (an odd number of quotes) or a constant;
    composed: the last constant before, swapped once for each swap after it."""
    ranges = lines.groupBy("source_file", "split").agg(
        F.max("rows_out").alias("rows_out"), F.max("rows_in").alias("rows_in"),
        F.max_by("end_out", "line").alias("end_out"), F.max_by("end_in", "line").alias("end_in"))
    order = Window.partitionBy("source_file").orderBy("split")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    constant, swap = F.col("end_out") == F.col("end_in"), F.col("end_out") & ~F.col("end_in")
    ranges = ranges.withColumn("swaps", F.sum(swap.cast("int")).over(upto))
    last = F.last(F.when(constant, F.struct("end_out", "swaps")), ignorenulls=True).over(before)
    ranges = ranges.withColumn("last", last).withColumn("passed", F.coalesce(F.lag("swaps").over(order), F.lit(0)))
    odd = (F.col("passed") - F.coalesce(F.col("last.swaps"), F.lit(0))) % 2 == 1
    ranges = ranges.withColumn("inside", F.coalesce(F.col("last.end_out"), F.lit(False)) != odd)
    rows = F.when(F.col("inside"), F.col("rows_in")).otherwise(F.col("rows_out"))
    return ranges.select(F.col("source_file").alias("of_file"), F.col("split").alias("of_split"), "inside",
                         F.coalesce(F.sum(rows).over(before), F.lit(0)).alias("rows_before"))


def read_rows(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """(source_file, row, text): every row of the files with its number, the header being 0."""
    text = (spark.read.option("lineSep", "\n").option("encoding", encoding)
            .text(path if isinstance(path, str) else list(path)))
    lines = text.select(F.col("_metadata.file_path").alias("source_file"),
                        F.col("_metadata.file_block_start").alias("split"), "value").mapInArrow(_scan, LINES_SCHEMA)
    known = lines.join(range_states(lines), (F.col("source_file") == F.col("of_file")) & (F.col("split") == F.col("of_split")))
    of_case = lambda c: F.when(F.col("inside"), F.col(f"{c}_in")).otherwise(F.col(f"{c}_out"))
    known = known.select("source_file", "split", "line", "value", of_case("kind").alias("kind"),
                         (F.col("rows_before") + of_case("rows") - 1).alias("row"))
    parts = (known.where(F.col("kind") == PART).groupBy("source_file", "row")
             .agg(F.array_sort(F.collect_list(F.struct("split", "line", "value"))).alias("parts"))
             .select("source_file", "row", F.array_join(F.col("parts.value"), "\n").alias("text")))
    whole = known.where(F.col("kind") == ROW).select("source_file", "row", F.col("value").alias("text"))
    return whole.unionByName(parts).withColumn("text", F.regexp_replace("text", r"\r\z", ""))


def parse_rows(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """(source_file, row_no, the columns): the rows' cells, without the header."""
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    cells = F.from_csv("text", ddl, {"escape": '"', "mode": "PERMISSIVE", "multiLine": "true"})
    parsed = rows.where("row > 0").select("source_file", (F.col("row") - 1).alias("row_no"), cells.alias("cells"))
    return parsed.select("source_file", "row_no", "cells.*")
