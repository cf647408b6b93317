"""Skew-safe building blocks: first / last row per key, and presence checks.

A window ``row_number() over (partition by key ...)`` sends every row of a key
to one task, so a key holding a third of the rows becomes a third of the job in
one task. Here the winner per key is found with a ``min``/``max`` aggregate
(partial aggregation combines a hot key map-side down to one row per map task)
and joined back on ``(key, order)``: that join hashes on both columns, so the
rows of a hot key spread over all partitions, and the aggregated side has one
row per key.

Presence checks ("is this key in that table?") are one left outer join where the
other side is unique on the key, and a semi/anti pair where it may repeat; both
read straight from shuffles, the shape AQE's skew-join rule can split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _all_not_null(keys: Sequence[str]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def flag_extreme_per_key(df: DataFrame, keys: Sequence[str], order: str, flag: str,
                         last: bool = False) -> DataFrame:
    """Add boolean ``flag``: True on the row with the smallest (``last``: largest)
    ``order`` among rows sharing ``keys``. ``order`` must be unique within a key.
    Rows with a NULL key are never grouped (flag True: each stands alone)."""
    keys = list(keys)
    agg = F.max(order) if last else F.min(order)
    winners = (df.where(_all_not_null(keys)).groupBy(*keys).agg(agg.alias(order))
               .withColumn(flag, F.lit(True)))
    out = df.join(winners, keys + [order], "left")
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    return out.withColumn(flag, F.coalesce(F.col(flag), any_null))


def keep_extreme_per_key(df: DataFrame, keys: Sequence[str], order: str,
                         last: bool = False) -> DataFrame:
    """Rows that win ``flag_extreme_per_key`` (one per non-NULL key).

    One pass over ``df``: ``max_by``/``min_by`` of the whole row, aggregated
    partially in every map task, so the input lineage is evaluated once and a
    hot key reaches the shuffle as one row per map task."""
    keys = list(keys)
    pick = F.max_by if last else F.min_by
    packed = (df.where(_all_not_null(keys)).groupBy(*keys)
              .agg(pick(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.col(order)).alias("_w")))
    return packed.select(*[F.col("_w").getField(c).alias(c) for c in df.columns])


def presence_flag(df: DataFrame, other: DataFrame, keys: Sequence[str], flag: str,
                  unique: bool = False) -> DataFrame:
    """Add boolean ``flag``: does ``other`` hold the same ``keys``? Never
    multiplies rows; rows with a NULL key are never present. No job runs while
    the plan is built; Spark broadcasts ``other`` only under its byte threshold.

    * ``unique`` - ``other`` holds each key at most once by contract (file names
      of a folder, a table's unique columns): one left outer join. No aggregate
      stands between shuffle and join, so AQE can split a hot key of ``df``.
    * otherwise a left-semi join (flag True) unioned with a left-anti join (flag
      False); both read straight from shuffles too, and repeats in ``other``
      do no harm."""
    keys = list(keys)
    right = other.select(*keys).where(_all_not_null(keys))
    if unique:
        known = right.withColumn(flag, F.lit(True))
        return (df.join(known, keys, "left")
                .withColumn(flag, F.coalesce(F.col(flag), F.lit(False))))
    hit = df.join(right, keys, "left_semi").withColumn(flag, F.lit(True))
    miss = df.join(right, keys, "left_anti").withColumn(flag, F.lit(False))
    return hit.unionByName(miss)
