"""Catalog maintenance as pure DataFrame -> DataFrame functions (D1-D5).

Parquet has no MERGE, so every change produces the next state of the table, or of
the rows it touches: ``sources.tables.save_table`` writes a full version,
``sources.log_table`` a delta. The catalog is unique on its business key; every
operator keeps it so.

Surrogate ids of inserted rows are ``max(id) + 1 + order`` where ``order`` is
the row's unique position in its batch (``row_no``): deterministic, above every
existing id, no global sort and no single-partition window. The maximum is a
scalar subquery (one partial + final aggregate over the ``id`` column only).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfetch import schemas as S
from docfetch.operators.keys import keep_extreme_per_key
from docfetch.operators.prepare import flag_duplicates, flag_duplicates_sequential


def _max_id(table: DataFrame, id_col: str):
    """``max(id)`` (0 for an empty table) as a scalar-subquery Column."""
    return table.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()


def latest_per_key(updates: DataFrame, key: str, order: str) -> DataFrame:
    """The last row per key by ``order`` (a later manifest row overwrites an
    earlier one, as sequential upserts would). NULL keys are dropped: the
    catalog key is NOT NULL (validation reports them)."""
    return keep_extreme_per_key(updates.where(F.col(key).isNotNull()), [key], order, last=True)


# D1
def upsert(catalog: DataFrame, updates: DataFrame, key: str = "brnumber", order: str = "row_no",
           id_col: str = "id", max_id: int | None = None) -> DataFrame:
    """Existing key: every column the update carries is replaced, ``id`` kept.
    New key: inserted with a fresh id. Keys without an update are unchanged.
    A full outer join of two sides unique on ``key``: no row multiplication and
    no hot key on either side. ``max_id`` is the greatest id given so far, if it is
    known (``catalog`` may then be only the rows of the updated keys)."""
    data_cols = [c for c in catalog.columns if c not in (id_col, key)]
    upd_cols = [c for c in data_cols if c in updates.columns]
    upd = latest_per_key(updates, key, order).select(
        key, F.col(order).cast("long").alias("_ord"),
        *[F.col(c).alias(f"_u_{c}") for c in upd_cols], F.lit(True).alias("_in_upd"))
    cat = catalog.withColumn("_in_cat", F.lit(True))
    j = cat.join(upd, key, "full_outer")
    max_id = _max_id(catalog, id_col) if max_id is None else F.lit(max_id).cast("long")
    in_upd = F.coalesce(F.col("_in_upd"), F.lit(False))
    out = []
    for c in catalog.columns:
        if c == id_col:
            out.append(F.when(F.col("_in_cat"), F.col(id_col))
                       .otherwise(max_id + 1 + F.col("_ord")).cast("long").alias(id_col))
        elif c == key:
            out.append(F.col(key))
        elif c in upd_cols:
            out.append(F.when(in_upd, F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


# D2
def append_rows(table: DataFrame, rows: DataFrame, keys: Sequence[str] = ("brnumber",),
                order: str = "row_no", id_col: str | None = "id") -> tuple[DataFrame, DataFrame]:
    """Insert rows whose unique keys are free (in the table and earlier in the
    batch). Returns (table after insert, rejected rows with ``reject_reason``)."""
    msgs = [S.MSG_UNIQUE_TAKEN for _ in keys]
    flagged = flag_duplicates(rows, list(keys), msgs, order, existing=table)
    accepted = flagged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    rejected = flagged.where(F.col("reject_reason").isNotNull())
    if id_col and id_col in table.columns:
        accepted = accepted.withColumn(id_col, (_max_id(table, id_col) + 1 + F.col(order)).cast("long"))
    new = accepted.select(*[c for c in table.columns if c in accepted.columns])
    return table.unionByName(new, allowMissingColumns=True), rejected


# D3
def update_rows(table: DataFrame, changes: DataFrame, key: str = "brnumber",
                order: str | None = "row_no") -> DataFrame:
    """Set only the columns ``changes`` carries, for keys present in the table;
    unknown keys change nothing (see ``update_misses``)."""
    cols = [c for c in changes.columns if c in table.columns and c != key]
    ch = latest_per_key(changes, key, order) if order and order in changes.columns else changes
    ch = ch.select(key, *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_hit"))
    j = table.join(ch, key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return j.select(*[F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
                      for c in table.columns])


def update_misses(table: DataFrame, changes: DataFrame, key: str = "brnumber") -> DataFrame:
    """Changes naming a key the table lacks (an error by id, a no-op by key)."""
    return changes.join(table.select(key), key, "left_anti")


# D4
def delete_rows(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def delete_misses(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Keys to delete that the table does not hold (the original answers 404)."""
    return keys.select(key).join(table.select(key), key, "left_anti")


# D5
def insert_if_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str] = ("username", "email"),
                     order: str = "row_no") -> DataFrame:
    """Rows to seed, as inserting them one at a time in ``order`` decides: none of
    their unique fields is in the table or on an *inserted* earlier row of the
    batch (a row that was refused takes no value)."""
    msgs = [f"{k} exists" for k in keys]
    out = flag_duplicates_sequential(rows, list(keys), msgs, order, existing=table)
    return out.where(F.col("reject_reason").isNull()).drop("reject_reason")
