"""Workbooks row by row: memory, shared strings, broken files, one scan for all."""

import io
import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from docfetch.fixtures import write_workbook
from docfetch.sources import manifest as M
from docfetch.sources import workbooks as W

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _shared_book(path, strings, rows):
    """A workbook whose cells refer to shared strings by number; ``rows`` may be a generator."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>'
                   '<sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/'
                   f'relationships"><Relationship Id="rId1" Type="{REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/sharedStrings.xml", "w", force_zip64=True) as f:
            f.write(f'<sst xmlns="{MAIN}">'.encode())
            for s in strings:
                f.write(f"<si><t>{s}</t></si>".encode())
            f.write(b"</sst>")
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(f'<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            for r, cells in enumerate(rows, 1):
                f.write(f'<row r="{r}">{"".join(f"""<c t="s"><v>{c}</v></c>""" for c in cells)}</row>'.encode())
            f.write(b"</sheetData></worksheet>")


def test_shared_strings_in_any_order():
    shared = W.SharedStrings(block=10, opened=2)
    words = [f"wörd {i}" for i in range(95)]
    for w in words:
        shared.append(w)
    for i in [0, 94, 50, 9, 10, 11, 89, 90, 3, 94, 42]:
        assert shared[i] == words[i]
    for i in (-1, 95):
        with pytest.raises(IndexError):
            shared[i]


def test_memory_does_not_grow_with_the_workbook(tmp_path):
    """Ten times the rows (shared strings, all distinct) take hardly more memory."""
    code = ("import sys, resource; sys.path.insert(0, {root!r}); from docfetch.sources import workbooks as W\n"
            "base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
            "n = sum(1 for _ in W.workbook_rows(open(sys.argv[1], 'rb')))\n"
            "print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base)").format(root=str(M.__file__.rsplit("/docfetch/", 1)[0]))
    used = {}
    for n in (20_000, 200_000):
        path = tmp_path / f"{n}.xlsx"
        _shared_book(path, [f"some text of row {i}, long enough to count" for i in range(n)], ([i] for i in range(n)))
        rows, grown = subprocess.run([sys.executable, "-c", code, str(path)], capture_output=True, text=True, check=True).stdout.split()
        assert int(rows) == n - 1
        used[n] = int(grown)
    assert used[200_000] - used[20_000] < 30_000         # kilobytes; the strings alone are 100 MB as objects


def test_one_scan_for_all_workbooks(spark, tmp_path):
    header = ["BRnum", "Title", "Pdf_URL"]
    for n in range(4):
        write_workbook(str(tmp_path / f"list {n}.xlsx"), header, [[f"K{n}-{i}", f"t{i}", None] for i in range(10 * n + 1)])
    (tmp_path / "broken.xlsx").write_bytes(b"not a zip")
    whole = io.BytesIO((tmp_path / "list 3.xlsx").read_bytes())
    with zipfile.ZipFile(whole) as z, zipfile.ZipFile(tmp_path / "cut.xlsx", "w") as out:
        for name in z.namelist():
            data = z.read(name)
            out.writestr(name, data[:len(data) * 2 // 3] if name.endswith("sheet1.xml") else data)
    df = M.read_manifest_xlsx(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 6                 # a partition a workbook
    name = F.substring_index("source_file", "/", -1)
    counts = {r["f"]: (r["n"], r["bad"]) for r in df.groupBy(name.alias("f")).agg(
        F.count(F.lit(1)).alias("n"), F.count("read_error").alias("bad")).collect()}
    # a workbook cut off in the middle is rejected whole: none of its first rows is run
    assert counts == {"list 0.xlsx": (1, 0), "list 1.xlsx": (11, 0), "list 2.xlsx": (21, 0), "list 3.xlsx": (31, 0),
                      "broken.xlsx": (1, 1), "cut.xlsx": (1, 1)}
    rows = M.read_manifests(spark, [str(tmp_path / f"list {n}.xlsx") for n in range(4)])
    assert rows.count() == 64 and rows.select("row_no").distinct().count() == 64
    contents = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    same = contents.mapInArrow(W.parse_contents, W.CELLS_SCHEMA)          # the way of other stores
    key = lambda r: (r["source_file"].rsplit("/", 1)[-1], r["row_no"], str(r["cells"]), r["read_error"])
    assert sorted(map(key, same.collect())) == sorted(map(key, df.collect()))
