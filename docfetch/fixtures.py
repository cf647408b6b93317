"""Views over the driver's Parquet tables that play the application's inputs.

Each view exists twice: as a Spark DataFrame (what the operators consume) and as
SQL text for the DuckDB oracle. The SQL texts are the definitions in
FIXTURES.md; the Spark side is written with the DataFrame API so column pruning
reaches the scans (``documents.text`` and ``pages.html`` are never read unless a
view needs them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE_FOLDER = "archive"
CATALOG_BASE_DATE = "2023-12-31 12:00:00"


_SCHEMAS: dict[str, object] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Its schema is inferred once and then given to the reader,
    so later reads start no footer-reading job."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = _SCHEMAS.get(path)
    if schema is None:
        df = spark.read.parquet(path)
        _SCHEMAS[path] = df.schema
        return df
    return spark.read.schema(schema).parquet(path)


def _s(c) -> F.Column:
    return c.cast("string")


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def t(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # manifest rows already mapped to catalog names
    def manifest_v(self) -> DataFrame:
        p = self.t("pages").select("page_id", "url")
        d = self.t("documents").select("doc_id", "source", "lang")
        n = self.t("nation").select("n_nationkey", "n_name", "n_regionkey")
        r = self.t("region").select("r_regionkey", "r_name")
        j = (p.join(d, p.page_id == d.doc_id)
             .join(n, n.n_nationkey == p.page_id % 25)
             .join(r, r.r_regionkey == n.n_regionkey))
        pid = F.col("page_id")
        base = "http://files.example.org/"
        pdf_url = (F.when(pid % 29 == 1, F.lit(None).cast("string"))
                   .when(pid % 17 == 1, F.concat(F.lit(base), F.col("lang"), F.lit("/shared.pdf")))
                   .when(pid % 3 == 0, F.concat(F.lit(base + "r"), _s(pid), F.lit(".pdf")))
                   .when(pid % 3 == 1, F.concat(F.lit(base + "R"), _s(pid), F.lit(".PDF")))
                   .otherwise(F.col("url")))
        backup = (F.when(pid % 10 == 0, F.lit(None).cast("string"))
                  .otherwise(F.concat(F.lit("http://backup.example.org/"), _s(pid), F.lit(".pdf"))))
        return j.select(
            pid.alias("row_no"),
            F.concat(F.lit("BR"), F.lpad(_s(pid), 6, "0")).alias("brnumber"),
            F.concat(F.col("source"), F.lit(" report "), _s(pid)).alias("title"),
            _s(F.lit(2017) + pid % 4).alias("publication_year"),
            F.col("source").alias("organization_name"),
            F.when(pid % 3 == 0, "Private").when(pid % 3 == 1, "Public").alias("organization_type"),
            F.col("lang").alias("organization_sector"),
            F.col("n_name").alias("country"),
            F.col("r_name").alias("region"),
            pdf_url.alias("pdf_url"),
            backup.alias("pdf_backup_url"),
        )

    # the same rows under the manifest's own header names, with no Region column
    def raw_manifest_v(self) -> DataFrame:
        m = self.manifest_v()
        return m.select(
            "row_no", F.col("brnumber").alias("BRnum"), F.col("title").alias("Title"),
            F.col("publication_year").alias("Publication Year"),
            F.col("organization_name").alias("Name"),
            F.col("organization_type").alias("Organization type"),
            F.col("organization_sector").alias("Sector"), F.col("country").alias("Country"),
            F.col("pdf_url").alias("Pdf_URL"), F.col("pdf_backup_url").alias("Report Html Address"))

    # the stored folder (names only)
    def files_v(self) -> DataFrame:
        m = self.manifest_v().where(F.col("row_no") % 5 == 0)
        rn = F.col("row_no")
        name = (F.when(rn % 3 == 0, F.concat(F.lit("r"), _s(rn), F.lit(".pdf")))
                .otherwise(F.concat(F.lit("R"), _s(rn), F.lit(".PDF"))))
        return m.select(name.alias("file_name")).distinct()

    def catalog_v(self) -> DataFrame:
        m = self.manifest_v().where(F.col("row_no") % 2 == 0)
        rn = F.col("row_no")
        done = rn % 4 == 0
        return m.select(
            (rn.cast("bigint") + 1).alias("id"), "brnumber", "title",
            F.when(done, F.concat(F.lit("r"), _s(rn), F.lit(".pdf"))).otherwise(F.lit("")).alias("file_name"),
            F.when(done, F.lit(ARCHIVE_FOLDER)).otherwise(F.lit("")).alias("file_folder"),
            "publication_year", "organization_name", "organization_type", "organization_sector",
            "country", "region",
            F.when(done, F.lit("TRUE")).otherwise(F.lit("FALSE")).alias("download_status"),
            F.when(done, F.lit("File downloaded successfully"))
            .otherwise(F.lit("Not received as PDF file")).alias("download_message"),
            F.lit(CATALOG_BASE_DATE).cast("timestamp_ntz").alias("download_attempt_date"),
            "pdf_url", "pdf_backup_url",
        )

    def payload_v(self) -> DataFrame:
        pid = F.col("page_id")
        return self.t("pages").select(
            pid.alias("row_no"),
            F.when(pid % 3 == 0, F.concat(F.lit("%PDF-1.4 "), _s(pid))).otherwise(F.col("html")).alias("content"))

    def attempts_v(self) -> DataFrame:
        e = self.t("events")
        et = F.col("event_type")
        return e.select(
            F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"),
            F.col("ts").alias("finished_at"),
            F.when(et.isin("click", "purchase"), "successful").when(et == "view", "already_downloaded")
            .otherwise("failed").alias("outcome"))

    def runs_v(self) -> DataFrame:
        a = self.attempts_v()
        rid = F.col("run_id")
        g = a.groupBy("run_id").agg(F.min("finished_at").alias("start_time"),
                                    F.max("finished_at").alias("end_time"),
                                    F.count(F.lit(1)).alias("processed_rows"))
        return g.select(
            rid.alias("task_id"),
            F.concat(F.lit("list_"), _s(rid % 20), F.lit(".xlsx")).alias("running_file"),
            F.when(rid % 3 == 0, "finished").when(rid % 3 == 1, "running").otherwise("cancelled").alias("status"),
            "start_time", "end_time", "processed_rows",
            (F.col("processed_rows") + rid % 2).alias("num_rows"))

    def accounts_v(self) -> DataFrame:
        c = self.t("customer")
        k = F.col("c_custkey")
        username = (F.when(k % 30 == 2, F.lit(None).cast("string")).when(k % 30 == 6, F.repeat(F.lit("x"), 60))
                    .when(k % 4 == 0, F.replace(F.col("c_name"), F.lit("#"), F.lit("_")))
                    .when(k % 4 == 1, F.lit("ab")).when(k % 4 == 2, F.col("c_name"))
                    .otherwise(F.concat(F.lit("User_"), _s(k % 60))))
        # some accounts share the e-mail of one whose user name was taken
        email = (F.when(k % 5 == 0, F.lit("bad.address"))
                 .otherwise(F.concat(F.lit("c"), _s(F.when(k % 16 == 8, (k + 3) % 72).when(k % 4 == 3, k % 72)
                                                    .otherwise(k % 700)), F.lit("@example.org"))))
        return c.select(k.alias("row_no"), username.alias("username"), email.alias("email"),
                        F.col("c_mktsegment").alias("segment"))

    # uploaded list files: several extensions, repeated names
    def uploads_v(self) -> DataFrame:
        d = self.t("documents").select("doc_id")
        k = F.col("doc_id")
        ext = (F.when(k % 7 == 0, ".csv").when(k % 7 == 1, ".xlsx").when(k % 7 == 2, ".xls")
               .when(k % 7 == 3, ".xlsm").when(k % 7 == 4, ".txt").when(k % 7 == 5, ".xltx")
               .otherwise(""))
        return d.select(k.alias("seq"),
                        F.concat(F.lit("list_"), _s(k % 40), ext).alias("file_name"))

    # run requests: one per sign-up event, for one of twenty list files
    def requests_v(self) -> DataFrame:
        e = self.t("events").where(F.col("event_type") == "signup")
        return e.select(F.col("event_id").alias("seq"), F.col("ts").alias("requested_at"),
                        F.concat(F.lit("list_"), _s(F.col("user_id") % 20), F.lit(".xlsx")).alias("running_file"))

    # cancel requests: one per error event; every fourth names an unknown task
    def cancels_v(self) -> DataFrame:
        e = self.t("events").where(F.col("event_type") == "error")
        eid = F.col("event_id")
        return e.select(eid.alias("seq"),
                        F.when(eid % 4 == 0, F.col("user_id") + 1000000).otherwise(F.col("user_id")).alias("task_id"))


# --- SQL text of the same views (DuckDB oracle) ----------------------------------

VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "manifest_v": ((), """
select p.page_id as row_no,
       concat('BR', lpad(cast(p.page_id as string), 6, '0')) as brnumber,
       concat(d.source, ' report ', cast(p.page_id as string)) as title,
       cast(2017 + p.page_id % 4 as string) as publication_year,
       d.source as organization_name,
       case p.page_id % 3 when 0 then 'Private' when 1 then 'Public' else null end as organization_type,
       d.lang as organization_sector,
       n.n_name as country,
       r.r_name as region,
       case when p.page_id % 29 = 1 then null
            when p.page_id % 17 = 1 then concat('http://files.example.org/', d.lang, '/shared.pdf')
            when p.page_id % 3 = 0 then concat('http://files.example.org/r', cast(p.page_id as string), '.pdf')
            when p.page_id % 3 = 1 then concat('http://files.example.org/R', cast(p.page_id as string), '.PDF')
            else p.url end as pdf_url,
       case when p.page_id % 10 = 0 then null
            else concat('http://backup.example.org/', cast(p.page_id as string), '.pdf') end as pdf_backup_url
from pages p
join documents d on d.doc_id = p.page_id
join nation n on n.n_nationkey = p.page_id % 25
join region r on r.r_regionkey = n.n_regionkey"""),
    "raw_manifest_v": (("manifest_v",), """
select row_no, brnumber as "BRnum", title as "Title", publication_year as "Publication Year",
       organization_name as "Name", organization_type as "Organization type",
       organization_sector as "Sector", country as "Country", pdf_url as "Pdf_URL",
       pdf_backup_url as "Report Html Address"
from manifest_v"""),
    "files_v": (("manifest_v",), """
select distinct case when row_no % 3 = 0 then concat('r', cast(row_no as string), '.pdf')
                     else concat('R', cast(row_no as string), '.PDF') end as file_name
from manifest_v where row_no % 5 = 0"""),
    "catalog_v": (("manifest_v",), f"""
select cast(row_no as bigint) + 1 as id, brnumber, title,
       case when row_no % 4 = 0 then concat('r', cast(row_no as string), '.pdf') else '' end as file_name,
       case when row_no % 4 = 0 then '{ARCHIVE_FOLDER}' else '' end as file_folder,
       publication_year, organization_name, organization_type, organization_sector, country, region,
       case when row_no % 4 = 0 then 'TRUE' else 'FALSE' end as download_status,
       case when row_no % 4 = 0 then 'File downloaded successfully' else 'Not received as PDF file' end as download_message,
       timestamp '{CATALOG_BASE_DATE}' as download_attempt_date,
       pdf_url, pdf_backup_url
from manifest_v where row_no % 2 = 0"""),
    "payload_v": ((), """
select page_id as row_no,
       case when page_id % 3 = 0 then concat('%PDF-1.4 ', cast(page_id as string)) else html end as content
from pages"""),
    "attempts_v": ((), """
select user_id as run_id, event_id as seq, ts as finished_at,
       case when event_type in ('click', 'purchase') then 'successful'
            when event_type = 'view' then 'already_downloaded' else 'failed' end as outcome
from events"""),
    "runs_v": (("attempts_v",), """
select run_id as task_id, concat('list_', cast(run_id % 20 as string), '.xlsx') as running_file,
       case run_id % 3 when 0 then 'finished' when 1 then 'running' else 'cancelled' end as status,
       min(finished_at) as start_time, max(finished_at) as end_time,
       count(*) as processed_rows, count(*) + run_id % 2 as num_rows
from attempts_v group by run_id"""),
    "accounts_v": ((), """
select c_custkey as row_no,
       case when c_custkey % 30 = 2 then null when c_custkey % 30 = 6 then repeat('x', 60)
            when c_custkey % 4 = 0 then replace(c_name, '#', '_') when c_custkey % 4 = 1 then 'ab'
            when c_custkey % 4 = 2 then c_name
            else concat('User_', cast(c_custkey % 60 as string)) end as username,
       case when c_custkey % 5 = 0 then 'bad.address'
            else concat('c', cast(case when c_custkey % 16 = 8 then (c_custkey + 3) % 72
                 when c_custkey % 4 = 3 then c_custkey % 72 else c_custkey % 700 end as string), '@example.org') end as email,
       c_mktsegment as segment
from customer"""),
    "uploads_v": ((), """
select doc_id as seq,
       concat('list_', cast(doc_id % 40 as string),
              case doc_id % 7 when 0 then '.csv' when 1 then '.xlsx' when 2 then '.xls'
                              when 3 then '.xlsm' when 4 then '.txt' when 5 then '.xltx' else '' end) as file_name
from documents"""),
    "requests_v": ((), """
select event_id as seq, ts as requested_at,
       concat('list_', cast(user_id % 20 as string), '.xlsx') as running_file
from events where event_type = 'signup'"""),
    "cancels_v": ((), """
select event_id as seq,
       case when event_id % 4 = 0 then user_id + 1000000 else user_id end as task_id
from events where event_type = 'error'"""),
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs of ``names`` and their dependencies, in order."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for dep in VIEW_SQL[n][0]:
            visit(dep)
        ordered.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} as ({VIEW_SQL[n][1]}\n)" for n in ordered)
    return f"with {ctes}\n{body.strip()}"


def write_workbook(path: str, header: list[str], rows) -> None:
    """A minimal workbook: one sheet of inline strings; an empty cell is left out."""
    import os
    import zipfile
    from xml.sax.saxutils import escape

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda c, r, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
    lines = [f'<row r="{r}">' + "".join(cell(c, r, v) for c, v in enumerate(row) if v is not None) + "</row>"
             for r, row in enumerate([header, *rows], 1)]
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>'
                   '<sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/'
                   f'2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/>'
                   '</Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
