"""Catalog queries: filter, sort, page, count, look-up, delivery, public view (E1-E8).

Filters are plain column equalities, so they reach the Parquet scan as pushed
filters; a sorted page is ``orderBy + offset + limit``, which Spark runs as a
per-task top-(offset+limit) followed by one small merge, never a full sort.
Deep pages should use ``page_after`` (keyset), which is a pushed range filter.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfetch import schemas as S

DEFAULT_PAGE_SIZE = 100


class QueryError(ValueError):
    """A request the original answers with 400 or 404."""


def parse_filters(filters: str | Mapping | None) -> dict:
    """Filter spec (JSON text or mapping) -> dict, with the original's checks:
    bad JSON, a None/"null" key or a None value is an error."""
    if filters is None or filters == "":
        return {}
    if isinstance(filters, str):
        try:
            spec = json.loads(filters)
        except json.JSONDecodeError as e:
            raise QueryError(S.MSG_BAD_FILTER_JSON) from e
    else:
        spec = dict(filters)
    if not isinstance(spec, dict):
        raise QueryError(S.MSG_BAD_FILTER_JSON)
    for k, v in spec.items():
        if k is None or k == "null":
            raise QueryError(S.MSG_NULL_FILTER_KEY)
        if v is None:
            raise QueryError(S.MSG_NULL_FILTER_VALUE.format(key=k))
    return spec


def clean_filters(spec: Mapping) -> dict:
    """What the browser sends: entries with an empty value dropped."""
    return {k: v for k, v in spec.items() if v not in ("", None)}


# E1
def filter_equals(df: DataFrame, filters: str | Mapping | None, collation: str | None = None) -> DataFrame:
    """AND of ``column == value``. The value is cast to the column's type with
    ``try_cast`` (a text that is no number matches nothing instead of failing).
    Text compares byte-wise (UTF8_BINARY) unless ``collation`` is given, e.g.
    ``UTF8_LCASE`` for the case-insensitive matching some databases default to."""
    spec = parse_filters(filters)
    types = dict(df.dtypes)
    for k, v in spec.items():
        if k not in types:
            raise QueryError(f"Unknown column {k}")
        val: Column = F.lit(str(v) if not isinstance(v, str) else v)
        col = F.col(k)
        if types[k] != "string":
            val = val.try_cast(types[k])
        elif collation:
            col, val = F.collate(col, collation), F.collate(val, collation)
        df = df.where(col == val)
    return df


def _sort_cols(sort_by: str | None, order: str | None, tie: str | None,
               collation: str | None = None) -> list[Column]:
    cols: list[Column] = []
    if sort_by and sort_by != "null":
        c = F.collate(F.col(sort_by), collation) if collation else F.col(sort_by)
        cols.append(c.asc_nulls_first() if order == "asc" else c.desc_nulls_last())
    if tie and tie != sort_by:
        cols.append(F.col(tie).asc_nulls_first())
    return cols


# E2
def sort_by(df: DataFrame, sort_by: str | None, order: str | None = "asc",
            tie: str | None = "brnumber", collation: str | None = None) -> DataFrame:
    """``asc`` ascending (NULLs first), anything else descending (NULLs last);
    None/"null" = no sort column. Ties always break on ``tie`` so pages are stable.
    ``collation`` (a text column only) orders e.g. case-insensitively."""
    if collation and dict(df.dtypes).get(sort_by) != "string":
        collation = None
    cols = _sort_cols(sort_by, order, tie, collation)
    return df.orderBy(*cols) if cols else df


# E3
def page(df: DataFrame, page_no: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    if page_no < 1:
        raise QueryError(S.MSG_BAD_PAGE)
    return df.offset((page_no - 1) * page_size).limit(page_size)


def page_after(df: DataFrame, sort_col: str, last_value, last_key, page_size: int = DEFAULT_PAGE_SIZE,
               order: str = "asc", key: str = "brnumber") -> DataFrame:
    """Keyset page: the rows after (``last_value``, ``last_key``) in the order
    ``sort_by`` gives (ascending: NULLs first; descending: NULLs last; ties on
    ``key``). A range filter plus a top-k: cost does not grow with the page
    number. ``last_value`` may be None (the last row seen had a NULL)."""
    c, k = F.col(sort_col), F.col(key)
    after_key = k > F.lit(last_key)
    if order == "asc":
        if last_value is None:        # inside the leading NULLs
            cond = (c.isNull() & after_key) | c.isNotNull()
        else:
            cond = (c > F.lit(last_value)) | ((c == F.lit(last_value)) & after_key)
        return df.where(cond).orderBy(c.asc_nulls_first(), k.asc()).limit(page_size)
    if last_value is None:            # inside the trailing NULLs
        cond = c.isNull() & after_key
    else:
        cond = (c < F.lit(last_value)) | ((c == F.lit(last_value)) & after_key) | c.isNull()
    return df.where(cond).orderBy(c.desc_nulls_last(), k.asc()).limit(page_size)


# E4
def count_matching(df: DataFrame, filters: str | Mapping | None = None, page_size: int = DEFAULT_PAGE_SIZE,
                   id_col: str = "id") -> DataFrame:
    """One row: ``total`` = count of non-NULL ids under the filter, ``total_pages``."""
    total = F.count(F.col(id_col)) if id_col in df.columns else F.count(F.lit(1))
    return (filter_equals(df, filters).agg(total.alias("total"))
            .withColumn("total_pages", F.ceil(F.col("total") / F.lit(page_size)).cast("long")))


def total_pages(total: int, page_size: int) -> int:
    return math.ceil(total / page_size)


# E5
def query_catalog(df: DataFrame, filters: str | Mapping | None = None, sort_col: str | None = None,
                  order: str | None = "asc", page_no: int = 1, page_size: int = DEFAULT_PAGE_SIZE,
                  tie: str = "brnumber") -> DataFrame:
    """One page of rows with ``total_pdfs`` (the filtered count) on every row. The
    count is a scalar subquery (partial counts per task, one final sum)."""
    filtered = filter_equals(df, filters)
    rows = page(sort_by(filtered, sort_col, order, tie), page_no, page_size)
    total = filtered.agg(F.count(F.col("id"))).scalar()
    return rows.withColumn("total_pdfs", total)


# E6
def lookup(df: DataFrame, key_col: str, keys: DataFrame | list) -> DataFrame:
    """Rows whose ``key_col`` is among ``keys`` (a DataFrame with that column, or
    a short list of values)."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(key_col).distinct(), key_col, "left_semi")
    return df.where(F.col(key_col).isin(list(keys)))


def lookup_misses(df: DataFrame, key_col: str, keys: DataFrame) -> DataFrame:
    """Requested keys the table lacks (the original answers 404 'not found')."""
    return keys.select(key_col).distinct().join(df.select(key_col), key_col, "left_anti")


# E7
def resolve_delivery(catalog: DataFrame, files: DataFrame, mode: str | None = None) -> DataFrame:
    """Per catalog row, all three answers of the document endpoint:
    ``local_uri`` (``file://folder/name``), the two ``link`` URLs, and for
    ``download`` either a ``deliver_path`` or the ``reason`` it cannot be
    delivered - no file name, file absent, status not TRUE, checked in that
    order. ``files`` lists stored files as (file_folder, file_name), each once.
    ``mode`` (``local`` / ``link`` / ``download``) keeps only that answer."""
    if mode is not None and mode not in S.DELIVERY_MODES:
        raise QueryError(S.MSG_BAD_RESPONSE_TYPE)
    from docfetch.operators.keys import presence_flag

    # rows without a file name are never looked up (they cannot be delivered):
    # a unique never-matching key keeps the mass of FALSE rows ('', '') spread
    name = F.coalesce(F.col("file_name"), F.lit(""))
    keyed = (catalog.withColumn("_salt", F.monotonically_increasing_id())
             .withColumn("_jfolder", F.coalesce(F.col("file_folder"), F.lit("")))
             .withColumn("_jname", F.when(name == "", F.concat(F.lit("\u0000"), F.col("_salt").cast("string")))
                         .otherwise(name)))
    listing = files.select(F.col("file_folder").alias("_jfolder"), F.col("file_name").alias("_jname"))
    j = presence_flag(keyed, listing, ["_jfolder", "_jname"], "_on_disk", unique=True)
    path = F.concat(F.coalesce(F.col("file_folder"), F.lit("None")), F.lit("/"),
                    F.coalesce(F.col("file_name"), F.lit("None")))
    no_name = F.coalesce(F.col("file_name"), F.lit("")) == ""
    absent = ~F.coalesce(F.col("_on_disk"), F.lit(False))
    not_true = ~F.coalesce(F.col("download_status") == S.STATUS_TRUE, F.lit(False))
    reason = (F.when(no_name, F.lit(S.MSG_PDF_NOT_FOUND)).when(absent, F.lit(S.MSG_PDF_NOT_FOUND))
              .when(not_true, F.lit(S.MSG_PDF_NOT_DOWNLOADED)))
    out = j.select(
        "brnumber",
        F.concat(F.lit("file://"), path).alias("local_uri"),
        "pdf_url", "pdf_backup_url",
        F.when(reason.isNull(), path).alias("deliver_path"),
        reason.alias("reason"))
    pick = {"local": ["local_uri"], "link": ["pdf_url", "pdf_backup_url"],
            "download": ["deliver_path", "reason"]}
    return out if mode is None else out.select("brnumber", *pick[mode])


# E8
def public_view(df: DataFrame, table: bool = False) -> DataFrame:
    """Columns the API answers with (no ``id``, ``file_folder``); ``table=True``
    also hides the URLs and the file name, as the browsing table does."""
    hidden = ["id", "file_folder"] + (["pdf_url", "pdf_backup_url", "file_name"] if table else [])
    return df.drop(*hidden)
