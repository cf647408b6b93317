"""The command line, run in-process against the test session."""

import json

from docfetch.__main__ import main


def test_cli_run_query_report_export_cancel(spark, tmp_path, capsys):
    site = tmp_path / "site"
    site.mkdir()
    (site / "a.pdf").write_bytes(b"%PDF-1.4 a")
    lst = tmp_path / "list.csv"
    lst.write_text(f"BRnum,Title,Pdf_URL\nK1,first,file://{site}/a.pdf\nK2,second,file://{site}/zz.pdf\n")
    state, dest = tmp_path / "state", tmp_path / "dest"
    dest.mkdir()

    assert main(["run", "--file", str(lst), "--state", str(state), "--dest", str(dest)]) == 0
    rec = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert rec["status"] == "finished" and rec["processed_rows"] == 2

    assert main(["query", "--state", str(state), "--filters", '{"download_status": "TRUE"}']) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert [r["brnumber"] for r in rows] == ["K1"] and rows[0]["total_pdfs"] == 1 and "id" not in rows[0]

    assert main(["report", "--state", str(state)]) == 0
    rep = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert rep["task_id"] == rec["task_id"] and rep["state"] == "finished"

    assert main(["export", "--state", str(state), "--out", str(tmp_path / "out"), "--compat"]) == 0
    capsys.readouterr()
    body = [r.value for r in spark.read.text(str(tmp_path / "out" / "body")).collect()]
    assert len(body) == 2

    assert main(["cancel", "--state", str(state), rec["task_id"]]) == 0
    ans = json.loads(capsys.readouterr().out.strip())
    assert ans["message"] == "Task is already finished"
