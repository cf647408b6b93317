"""Workbooks as a data source: a partition per file, rows handed over as they are parsed.

A sheet is read element by element and each row element is dropped once used; the
workbook's shared strings, which a cell may refer to in any order, are kept in compressed
blocks of which a few are open. So a task holds a batch of rows and those blocks, not the
workbook. A workbook is parsed twice, first only to see that it can be read to its end:
one that cannot be read becomes one row with ``read_error`` set and no other rows (a bad
file is rejected; it does not stop a run, or a stream that would replay it for ever).
"""

from __future__ import annotations

import datetime as dt
import io
import itertools
import json
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import IO

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docfetch.session import to_local_path

WORKBOOK_EXTENSIONS = (".xlsx", ".xlsm", ".xltx", ".xltm")
CELLS_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType(), True),
    T.StructField("row_no", T.LongType(), True),
    T.StructField("cells", T.MapType(T.StringType(), T.StringType(), True), True),
    T.StructField("read_error", T.StringType(), True),
])
BATCH_ROWS = 5000


class SharedStrings:
    """The strings by number, in compressed blocks. Cells mostly refer to strings near those
    of the cells before (a string is numbered where it first occurs), so few blocks are open."""

    def __init__(self, block: int = 4096, opened: int = 64):
        self._block, self._size = block, 0
        self._last: list[str] = []
        self._blocks: list[bytes] = []
        self._open = lru_cache(opened)(lambda b: json.loads(zlib.decompress(self._blocks[b])))

    def append(self, text: str) -> None:
        self._last.append(text)
        self._size += 1
        if len(self._last) == self._block:
            self._blocks.append(zlib.compress(json.dumps(self._last).encode(), 1))
            self._last = []

    def __getitem__(self, i: int) -> str:
        if not 0 <= i < self._size:
            raise IndexError(f"shared string {i}")
        block, at = divmod(i, self._block)
        return (self._open(block) if block < len(self._blocks) else self._last)[at]


def _elements(stream: IO[bytes], parent: str, child: str) -> Iterator[ET.Element]:
    """The children of an element one by one; each is dropped before the next is read."""
    holder = None
    for event, el in ET.iterparse(stream, events=("start", "end")):
        if event == "start" and el.tag == parent:
            holder = el
        elif event == "end" and el.tag == child:
            yield el
            if holder is not None:
                holder.clear()


def workbook_rows(book: IO[bytes]) -> Iterator[tuple[int, dict]]:
    """(row_no, {header: text}) for the active sheet of an OOXML workbook. Empty cells are
    None; numbers keep the text Excel stored, integral numbers without a fractional part;
    cells with a date format give ``YYYY-MM-DD hh:mm:ss``."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rns = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    zf = zipfile.ZipFile(book)
    names = set(zf.namelist())

    shared = SharedStrings()
    if "xl/sharedStrings.xml" in names:
        for el in _elements(zf.open("xl/sharedStrings.xml"), ns + "sst", ns + "si"):
            shared.append("".join(t.text or "" for t in el.iter(ns + "t")))

    wb = ET.fromstring(zf.read("xl/workbook.xml"))
    active = 0
    view = wb.find(f"{ns}bookViews/{ns}workbookView")
    if view is not None and view.get("activeTab"):
        active = int(view.get("activeTab"))
    sheets = wb.findall(f"{ns}sheets/{ns}sheet")
    rid = sheets[active].get(rns + "id")
    rels = ET.fromstring(zf.read("xl/_rels/workbook.xml.rels"))
    target = None
    for rel in rels:
        if rel.get("Id") == rid:
            target = rel.get("Target")
    if target.startswith("/"):
        sheet_path = target.lstrip("/")
    else:
        sheet_path = posixpath.normpath(posixpath.join("xl", target))

    # style index -> is its number format one for dates (built-in 14-22, 45-47, or
    # a custom one with day, month, year or hour letters outside quotes)
    dated: list[bool] = []
    if "xl/styles.xml" in names:
        styles = ET.fromstring(zf.read("xl/styles.xml"))
        custom = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode") or "")
                  for f in styles.iter(ns + "numFmt")}
        ids = [int(x.get("numFmtId") or 0) for x in styles.findall(f"{ns}cellXfs/{ns}xf")]
        dated = [14 <= i <= 22 or 45 <= i <= 47 or bool(re.search("[dmyhDMYH]", custom.get(i, ""))) for i in ids]
    epoch = wb.find(f"{ns}workbookPr")
    first_day = dt.datetime(1904, 1, 1) if epoch is not None and epoch.get("date1904") in ("1", "true") \
        else dt.datetime(1899, 12, 30)

    def col_index(ref: str) -> int:
        letters = re.match(r"[A-Z]+", ref).group(0)
        n = 0
        for ch in letters:
            n = n * 26 + (ord(ch) - 64)
        return n - 1

    def cell_text(c) -> str | None:
        t = c.get("t")
        if t == "inlineStr":
            is_ = c.find(ns + "is")
            return None if is_ is None else "".join(x.text or "" for x in is_.iter(ns + "t"))
        v = c.find(ns + "v")
        if v is None or v.text is None:
            return None
        if t == "s":
            return shared[int(v.text)]
        if t == "b":
            return "True" if v.text == "1" else "False"
        if t in ("str", "e"):
            return v.text
        txt = v.text
        try:
            f = float(txt)
            style = int(c.get("s") or 0)
            if style < len(dated) and dated[style]:
                return str(first_day + dt.timedelta(seconds=round(f * 86400)))
            if f.is_integer() and "e" not in txt.lower():
                return str(int(f))
            return repr(f)
        except ValueError:
            return txt

    # Positions follow the sheet's row numbers (attribute ``r``, 1-based): the
    # header is row 1 and data row ``r`` is ``row_no = r - 2``, so a slice means
    # the same sheet rows even when blank rows are missing from the XML.
    headers: list | None = None
    seq = 0
    for el in _elements(zf.open(sheet_path), ns + "sheetData", ns + "row"):
        seq += 1
        r_attr = el.get("r")
        sheet_row = int(r_attr) if r_attr else seq
        values: dict[int, str | None] = {}
        for pos, c in enumerate(el.findall(ns + "c")):
            ref = c.get("r")
            values[col_index(ref) if ref else pos] = cell_text(c)
        width = (max(values) + 1) if values else 0
        row = [values.get(i) for i in range(width)]
        if sheet_row == 1:
            headers = row
            continue
        if headers is None:
            headers = []
        cells = {}
        for i, h in enumerate(headers):
            if h is None:
                continue
            cells[str(h)] = row[i] if i < len(row) else None
        yield sheet_row - 2, cells


def _batches(source_file: str, book: IO[bytes]):
    """Arrow batches of one workbook's rows, or one row that says why it cannot be read."""
    import pyarrow as pa

    kind = pa.map_(pa.string(), pa.string())

    def batch(rows, error=None):
        return pa.RecordBatch.from_arrays(
            [pa.array([source_file] * len(rows), pa.string()), pa.array([r for r, _ in rows], pa.int64()),
             pa.array([list(c.items()) for _, c in rows], kind), pa.array([error] * len(rows), pa.string())],
            names=CELLS_SCHEMA.fieldNames())

    try:
        for _ in workbook_rows(book):
            pass
    except Exception as e:  # noqa: BLE001 - reported per file
        yield batch([(-1, {})], f"{type(e).__name__}: {e}")
        return
    book.seek(0)
    rows = workbook_rows(book)
    while some := list(itertools.islice(rows, BATCH_ROWS)):
        yield batch(some)


def parse_contents(batches):
    """Workbooks that Spark read as values: (path, content) rows."""
    for part in batches:
        for path, content in zip(part["path"], part["content"]):
            yield from _batches(path.as_py(), io.BytesIO(content.as_buffer()))


class _Workbook(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_Workbook(p) for p in self.paths]

    def read(self, partition: _Workbook):
        try:
            book = open(to_local_path(partition.path), "rb")
        except OSError as e:
            raise RuntimeError(f"executors cannot open {partition.path}: {e}") from e
        with book:
            yield from _batches(partition.path, book)


class WorkbookSource(DataSource):
    """``spark.read.format("docfetch_workbooks").option("paths", <JSON list>)``."""

    @classmethod
    def name(cls) -> str:
        return "docfetch_workbooks"

    def schema(self) -> T.StructType:
        return CELLS_SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(json.loads(self.options["paths"]))
