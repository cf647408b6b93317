"""Decide per manifest row what to do (C1-C3) and shape outcomes into catalog rows (C7).

No manifest row is ever multiplied. The folder check is a presence check
(``keys.presence_flag``): a left outer join on the names, which are unique in a
folder, that AQE can split on a name many rows share (a listing that may repeat
names, as of several folders, uses the semi/anti pair). The catalog check is a left join against rows unique
on ``brnumber``, broadcast only under ``spark.sql.autoBroadcastJoinThreshold``
(AQE re-checks the measured size), otherwise shuffle-joined with AQE free to
split a hot key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfetch import schemas as S
from docfetch.functions import columns as C


def _now_literal(now: dt.datetime | str | Column) -> Column:
    if isinstance(now, Column):
        return now.cast("timestamp_ntz")
    if isinstance(now, dt.datetime):
        now = now.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(now)).cast("timestamp_ntz")


# C1
def mark_existing_files(df: DataFrame, files: DataFrame, name_col: str = "file_name",
                        flag: str = "in_folder", unique_names: bool = True) -> DataFrame:
    """``flag`` = the row's raw file name is in the folder listing **and** ends in
    ``.pdf`` in any case (a stored ``report.pdf`` does not cover a raw
    ``report``: the test is on the raw name).

    ``files`` holds each name once, as the listing of one folder does; pass
    ``unique_names=False`` for a listing that may repeat names. Rows whose name is NULL or empty can never match a listed file;
    they join on a unique NUL-prefixed key (no file name contains NUL), so a
    mass of missing URLs spreads over all partitions instead of hashing to one."""
    from docfetch.operators.keys import presence_flag

    listing = (files.select(F.col(name_col).alias("_jkey"))
               .where(F.col("_jkey").isNotNull() & (F.col("_jkey") != "")))
    name = F.col(name_col)
    salted = (df.withColumn("_salt", F.monotonically_increasing_id())
              .withColumn("_jkey", F.when(name.isNull() | (name == ""),
                                          F.concat(F.lit("\u0000"), F.col("_salt").cast("string")))
                          .otherwise(name)))
    out = presence_flag(salted, listing, ["_jkey"], "_present", unique=unique_names)
    return (out.withColumn(flag, F.col("_present") & F.coalesce(C.has_pdf_suffix(name_col), F.lit(False)))
            .drop("_present", "_salt", "_jkey"))


# C2
def mark_already_downloaded(df: DataFrame, catalog: DataFrame, key: str = "brnumber",
                            flag: str = "in_catalog") -> DataFrame:
    """``flag`` = the catalog holds the key with status TRUE; its stored folder and
    file name come along as ``catalog_folder`` / ``catalog_file_name``."""
    done = (catalog.where(F.col("download_status") == S.STATUS_TRUE)
            .select(F.col(key).alias("_cat_key"),
                    F.col("file_folder").alias("catalog_folder"),
                    F.col("file_name").alias("catalog_file_name"),
                    F.lit(True).alias("_cat_hit")))
    out = df.join(done, F.col(key) == F.col("_cat_key"), "left")
    return (out.withColumn(flag, F.coalesce(F.col("_cat_hit"), F.lit(False)))
            .drop("_cat_key", "_cat_hit"))


# C3
def plan_fetch(manifest: DataFrame, files: DataFrame, catalog: DataFrame, dest: str,
               url_col: str = "pdf_url", unique_names: bool = True) -> DataFrame:
    """Per row: ``decision`` in (already_downloaded, failed, fetch), with the
    planned ``file_folder``, ``stored_name`` and ``message``. Priority: raw name in
    the folder, then key TRUE in the catalog, then a missing URL fails, else fetch.
    ``unique_names``: see ``mark_existing_files``.
    """
    df = manifest.withColumn("file_name", C.base_name(url_col))
    df = mark_existing_files(df, files, unique_names=unique_names)
    df = mark_already_downloaded(df, catalog)
    in_folder, in_cat = F.col("in_folder"), F.col("in_catalog")
    missing = F.col(url_col).isNull()
    decision = (F.when(in_folder, F.lit("already_downloaded"))
                .when(in_cat, F.lit("already_downloaded"))
                .when(missing, F.lit("failed"))
                .otherwise(F.lit("fetch")))
    cat_msg = C.fill_template(S.MSG_ALREADY_TRUE, brnumber=F.col("brnumber"),
                              folder=F.col("catalog_folder"), dest=dest)
    message = (F.when(in_folder, F.lit(S.MSG_EXISTS_IN_FOLDER))
               .when(in_cat, cat_msg)
               .when(missing, F.lit(S.MSG_MISSING_URL)))
    folder = (F.when(in_folder, F.lit(dest)).when(in_cat, F.col("catalog_folder"))
              .when(missing, F.lit("")))
    name = (F.when(in_folder, F.col("file_name")).when(in_cat, F.col("catalog_file_name"))
            .when(missing, F.lit("")).otherwise(C.stored_name("file_name")))
    return (df.withColumn("decision", decision)
            .withColumn("message", message)
            .withColumn("file_folder", folder)
            .withColumn("stored_name", name)
            .drop("catalog_folder", "catalog_file_name"))


# C7
def shape_result(outcomes: DataFrame, now: dt.datetime | str | Column) -> DataFrame:
    """Outcome rows -> catalog rows. ``outcome`` successful / already_downloaded
    gives status TRUE; failed gives FALSE and blanks folder and file name.
    ``now`` is passed in (a literal), never ``current_timestamp``."""
    ok = F.col("outcome").isin("successful", "already_downloaded")
    return outcomes.select(
        *[F.col(c) for c in ("row_no",) if c in outcomes.columns],
        F.col("brnumber"), F.col("title"),
        F.when(ok, F.col("stored_name")).otherwise(F.lit("")).alias("file_name"),
        F.when(ok, F.col("file_folder")).otherwise(F.lit("")).alias("file_folder"),
        "publication_year", "organization_name", "organization_type", "organization_sector",
        "country", "region",
        F.when(ok, F.lit(S.STATUS_TRUE)).otherwise(F.lit(S.STATUS_FALSE)).alias("download_status"),
        F.col("message").alias("download_message"),
        _now_literal(now).alias("download_attempt_date"),
        "pdf_url", "pdf_backup_url",
    )

