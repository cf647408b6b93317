"""A1-A7 on files generated into tmp_path (FIXTURES §4)."""

import csv
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from docfetch import schemas as S
from docfetch.operators import prepare as P
from docfetch.sources import manifest as M
from docfetch.sources import tables as TB

HEADERS = list(S.MANIFEST_COLUMN_MAP)


def _write_csv(path, header, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


def _basic_rows(n=25):
    return [[f"BR{i:03d}", f"T{i}", "2019", "Org", "Private", "Energy", "NO", "Europe",
             f"http://h/r{i}.pdf", f"http://b/r{i}.pdf"] for i in range(n)]


def test_csv_row_positions_and_slices(spark, tmp_path):
    p = tmp_path / "basic.csv"
    _write_csv(p, HEADERS, _basic_rows())
    df = M.read_manifest_csv(spark, str(p))
    rows = {r["row_no"]: r["BRnum"] for r in df.collect()}
    assert rows == {i: f"BR{i:03d}" for i in range(25)}
    m = P.map_columns(df)
    assert P.slice_rows(m, 5, 10).count() == 10
    assert sorted(r.row_no for r in P.slice_rows(m, 5, 10).collect()) == list(range(5, 15))
    assert P.slice_rows(m, 0, 0).count() == 25          # Q1: 0 = all
    assert P.slice_rows(m, 0, None).count() == 25
    assert P.slice_rows(m, 30, 10).count() == 0


def test_csv_row_positions_on_split_file(spark, tmp_path):
    """A file cut into many splits (multi_line=False) still gets file-order positions."""
    p = tmp_path / "big.csv"
    _write_csv(p, HEADERS, _basic_rows(20000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = M.read_manifest_csv(spark, str(p), multi_line=False)
        bad = df.where(F.col("BRnum") != F.format_string("BR%03d", F.col("row_no")))
        assert df.rdd.getNumPartitions() > 1
        assert df.count() == 20000 and bad.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_ragged_rows(spark, tmp_path):
    """Q2/Q3: empty cell NULL, short row NULL-padded, long row cut, quoted comma/newline kept."""
    p = tmp_path / "ragged.csv"
    with open(p, "w", newline="") as f:
        f.write(",".join(HEADERS) + "\n")
        f.write('A,"title, with comma",2019,,,,,,http://h/a.pdf,\n')
        f.write("B,short\n")
        f.write("C,t,2019,n,t,s,c,r,http://h/c.pdf,http://b/c.pdf,EXTRA\n")
        f.write('D,"two\nlines",2020,n,t,s,c,r,http://h/d.pdf,x\n')
    df = M.read_manifest_csv(spark, str(p))
    r = {x["BRnum"]: x for x in df.collect()}
    assert r["A"]["Title"] == "title, with comma" and r["A"]["Name"] is None
    assert r["B"]["Title"] == "short" and r["B"]["Pdf_URL"] is None
    assert r["C"]["Report Html Address"] == "http://b/c.pdf"
    assert r["D"]["Title"] == "two\nlines" and r["D"]["row_no"] == 3


def test_wrong_header_is_rejected(spark, tmp_path):
    """Q12: a missing required column is an up-front error."""
    p = tmp_path / "wrong_header.csv"
    _write_csv(p, ["Title", "pdf_url"], [["t", "http://h/x.pdf"]])
    with pytest.raises(ValueError, match="BRnum"):
        P.require_columns(M.read_manifest_csv(spark, str(p)))


def _xlsx(path, sheets, active=0):
    """Minimal workbook written with the stdlib: shared + inline strings, numbers."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shared = []

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if v.startswith("inline:"):
            return f'<c r="{ref}" t="inlineStr"><is><t>{v[7:]}</t></is></c>'
        shared.append(v)
        return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'

    sheet_xml = []
    for rows in sheets:
        body = []
        for i, row in enumerate(rows, start=1):
            if row is None:      # a blank sheet row: absent from the XML
                continue
            cells = "".join(cell(f"{chr(65 + j)}{i}", v) for j, v in enumerate(row))
            body.append(f'<row r="{i}">{cells}</row>')
        sheet_xml.append(f'<?xml version="1.0"?><worksheet {ns}><sheetData>{"".join(body)}</sheetData></worksheet>')
    sst = "".join(f"<si><t>{s}</t></si>" for s in shared)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml",
                   f'<?xml version="1.0"?><workbook {ns} {rns}><bookViews><workbookView activeTab="{active}"/>'
                   f'</bookViews><sheets>'
                   + "".join(f'<sheet name="S{i}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i in range(len(sheets)))
                   + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>'
                             for i in range(len(sheets))) + "</Relationships>")
        for i, x in enumerate(sheet_xml):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", x)
        z.writestr("xl/sharedStrings.xml", f'<?xml version="1.0"?><sst {ns}>{sst}</sst>')


def test_xlsx_reader(spark, tmp_path):
    d = tmp_path / "books"
    d.mkdir()
    _xlsx(d / "a.xlsx", [[["BRnum", "Title", "Publication Year", "Pdf_URL"],
                          ["BR1", "inline:First", 2019, "http://h/1.pdf"],
                          None,
                          ["BR2", None, 2020.5, "http://h/2.pdf"]],
                         [["BRnum"], ["IGNORED"]]])
    _xlsx(d / "b.xlsm", [[["other"], ["x"]], [["BRnum", "Pdf_URL"], ["BR9", "http://h/9.pdf"]]], active=1)
    (d / "x.xls").write_bytes(b"")
    (d / "y.txt").write_bytes(b"")
    cells = M.read_manifest_xlsx(spark, str(d))
    m = {r["brnumber"]: r for r in M.expand_cells(cells).collect()}
    assert set(m) == {"BR1", "BR2", "BR9"}
    assert m["BR1"]["title"] == "First" and m["BR1"]["publication_year"] == "2019"
    assert m["BR2"]["title"] is None and m["BR2"]["publication_year"] == "2020.5"   # Q2: empty cell NULL
    assert m["BR1"]["region"] == ""                                                # absent header -> ''
    assert m["BR9"]["pdf_url"] == "http://h/9.pdf" and m["BR9"]["row_no"] == 0     # active sheet only
    assert m["BR1"]["row_no"] == 0 and m["BR2"]["row_no"] == 2                     # sheet row numbers


def test_list_stored_files(spark, tmp_path):
    d = tmp_path / "pdf-files"
    d.mkdir()
    (d / "a.pdf").write_bytes(b"%PDF-1.4")
    (d / f".docfetch-{'0' * 32}.part").write_bytes(b"x")            # a fetch in progress
    df = TB.list_stored_files(spark, str(d))
    assert [r.file_name for r in df.collect()] == ["a.pdf"]
    assert TB.list_stored_files(spark, str(tmp_path / "absent")).count() == 0


def test_export_csv_default_and_compat(spark, tmp_path):
    import datetime as dt
    rows = [(1, "BR1", "a, b", dt.datetime(2024, 1, 1, 0, 0, 0, 100000)), (2, "BR2", None, dt.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "id long, brnumber string, title string, ts timestamp_ntz")
    out = str(tmp_path / "plain")
    TB.export_csv(df, out)
    back = spark.read.option("header", True).csv(out)
    assert sorted(r.title or "" for r in back.collect()) == ["", "a, b"]
    out2 = str(tmp_path / "compat")
    TB.export_csv(df, out2, compat=True)
    header = spark.read.text(f"{out2}/header").first().value
    body = sorted(r.value for r in spark.read.text(f"{out2}/body").collect())
    assert header == "id,brnumber,title,ts"
    assert body == ["1,BR1,a, b,2024-01-01 00:00:00.100000", "2,BR2,None,2024-01-02 00:00:00"]  # Q18


def test_save_table_versions(spark, tmp_path):
    root = str(tmp_path / "catalog")
    assert TB.read_latest(spark, root) is None
    df1 = spark.createDataFrame([("BR1", "FALSE")], "brnumber string, download_status string")
    p1 = TB.save_table(df1, root)
    df2 = TB.read_latest(spark, root).withColumn("download_status", F.lit("TRUE"))
    p2 = TB.save_table(df2, root, bucket_by="brnumber", num_buckets=2)   # never overwrites what it reads
    assert p1 != p2 and os.path.isdir(p1)
    assert TB.read_latest(spark, root).first().download_status == "TRUE"


def test_row_positions_per_file_when_reading_many(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    for f, n in (("a.csv", 7), ("b.csv", 3), ("c.csv", 12)):
        _write_csv(d / f, HEADERS, [[f"{f}-{i}", "", "", "", "", "", "", "", "u", ""] for i in range(n)])
    df = M.read_manifest_csv(spark, str(d))
    got = {}
    for r in df.collect():
        got.setdefault(r.source_file.rsplit("/", 1)[-1], []).append((r.row_no, r.BRnum))
    for f, rows in got.items():
        assert sorted(rows) == [(i, f"{f}-{i}") for i in range(len(rows))]
    assert sorted(len(v) for v in got.values()) == [3, 7, 12]


def test_default_export_survives_newlines_and_quotes(spark, tmp_path):
    """Q18: the quoted export keeps commas, quotes and newlines inside a field."""
    rows = [(1, 'a "quoted", multi\nline title'), (2, "plain")]
    df = spark.createDataFrame(rows, "id long, title string")
    out = str(tmp_path / "q18")
    TB.export_csv(df, out)
    back = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .schema("id long, title string").csv(out))
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_xlsx_date_cells(spark, tmp_path):
    """A number under a date format is a date; under another format it stays a number."""
    import zipfile

    from docfetch.fixtures import write_workbook
    path = tmp_path / "dates.xlsx"
    write_workbook(str(path), ["BRnum", "Title", "Pdf_URL"], [["K1", "t", "u"]])
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n).decode() for n in z.namelist()}
    parts["xl/styles.xml"] = (f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/></numFmts>'
                              '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>')
    row = '<row r="3"><c r="A3" s="1"><v>43831</v></c><c r="B3" s="2"><v>43831.5</v></c><c r="C3" s="0"><v>43831</v></c></row>'
    parts["xl/worksheets/sheet1.xml"] = parts["xl/worksheets/sheet1.xml"].replace("</sheetData>", row + "</sheetData>")
    with zipfile.ZipFile(path, "w") as z:
        for n, text in parts.items():
            z.writestr(n, text)
    cells = {r.row_no: r.cells for r in M.read_manifest_xlsx(spark, str(path)).collect()}
    assert cells[1] == {"BRnum": "2020-01-01 00:00:00", "Title": "2020-01-01 12:00:00", "Pdf_URL": "43831"}
