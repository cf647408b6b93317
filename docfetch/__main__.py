"""Command line: ``python -m docfetch <command> ...`` (or ``spark-submit docfetch/__main__.py ...``).

    run     --file F --state S --dest D [--start-row N] [--num-rows N]   one manifest file, prints the run record
    cancel  --state S TASK_ID ...                                        cancel running runs
    query   --state S [--filters JSON] [--sort-by C] [--order asc|desc] [--page N] [--page-size N] [--indexed]
    export  --state S --out PATH [--compat]                              catalog as CSV part files
    report  --state S                                                    one line per run (status, times, results)
"""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="docfetch")
    sub = ap.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("run")
    r.add_argument("--file", required=True)
    r.add_argument("--state", required=True)
    r.add_argument("--dest", required=True)
    r.add_argument("--start-row", type=int, default=None)
    r.add_argument("--num-rows", type=int, default=None)
    r.add_argument("--partitions", type=int, default=None)
    r.add_argument("--concurrency", type=int, default=8)
    r.add_argument("--host-slots", type=int, default=None)
    r.add_argument("--single-line", action="store_true", help="no line breaks inside cells: large CSVs are split")
    r.add_argument("--encoding", default="UTF-8")
    c = sub.add_parser("cancel")
    c.add_argument("--state", required=True)
    c.add_argument("task_ids", nargs="+")
    q = sub.add_parser("query")
    q.add_argument("--state", required=True)
    q.add_argument("--filters", default=None)
    q.add_argument("--sort-by", default=None)
    q.add_argument("--order", default="asc")
    q.add_argument("--page", type=int, default=1)
    q.add_argument("--page-size", type=int, default=100)
    q.add_argument("--indexed", action="store_true", help="keep a page index of this query: deep pages read their files only")
    e = sub.add_parser("export")
    e.add_argument("--state", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--compat", action="store_true")
    p = sub.add_parser("report")
    p.add_argument("--state", required=True)
    p.add_argument("--limit", type=int, default=1000, help="the latest runs to print")
    args = ap.parse_args(argv)

    from docfetch.session import get_session

    spark = get_session("docfetch")
    if args.cmd == "run":
        from docfetch.plans.job import run_file
        rec = run_file(spark, args.file, args.state, args.dest, args.start_row, args.num_rows,
                       num_partitions=args.partitions, concurrency=args.concurrency, host_slots=args.host_slots,
                       multi_line=not args.single_line, encoding=args.encoding)
        print(json.dumps(rec, default=str))
        return 0
    if args.cmd == "cancel":
        from docfetch.plans.job import cancel_runs
        for row in cancel_runs(spark, args.state, args.task_ids).collect():
            print(json.dumps({"task_id": row["task_id"], "message": row["message"]}))
        return 0

    from docfetch.plans.job import read_catalog
    catalog = read_catalog(spark, args.state)
    if args.cmd == "query":
        from docfetch.operators.browse import public_view, query_catalog
        from docfetch.operators.page_index import query_catalog_indexed
        from docfetch.sources.log_table import read_commit
        state = args.state.rstrip("/")
        if args.indexed:
            found = query_catalog_indexed(catalog, str(read_commit(spark, f"{state}/catalog")[0]), f"{state}/pages",
                                          args.filters, args.sort_by, args.order, args.page, args.page_size)
        else:
            found = query_catalog(catalog, args.filters, args.sort_by, args.order, args.page, args.page_size)
        rows = public_view(found).collect()
        if not rows:
            print("No PDFs found in the given range", file=sys.stderr)
            return 1
        for row in rows:
            print(json.dumps(row.asDict(), default=str))
        return 0
    if args.cmd == "export":
        from docfetch.sources.tables import export_csv
        if catalog.isEmpty():
            print("no catalog yet", file=sys.stderr)
            return 1
        print(export_csv(catalog, args.out, compat=args.compat))
        return 0
    if args.cmd == "report":
        from pyspark.sql import functions as F

        from docfetch.plans.job import report
        runs = report(spark, args.state, F.current_timestamp().cast("timestamp_ntz"))
        for row in runs.orderBy(F.col("start_time").desc()).limit(args.limit).collect():
            print(json.dumps(row.asDict(), default=str))
        return 0
    return 2


if __name__ == "__main__":
    sys.exit(main())
