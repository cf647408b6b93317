"""Deep pages of a sorted, filtered catalog, answered from a range or two (E3, E5).

``offset`` makes every task keep as many rows as lie before the page. Instead the rows of
one query (filter and order) are sorted once into ranges: written in order, a folder per
range, each row with its place in the range. The counts per range - a row each - are the
index: they tell the total, and which ranges hold the rows of any page, so a page reads
those files only, from the row groups that hold its places.

An index belongs to one version of the catalog and one query, which name its folder; the
first asking builds it, later ones and all other pages of the query find it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docfetch import schemas as S
from docfetch.operators import browse as BR
from docfetch.sources import tables as TB


def build(rows: DataFrame, root: str, sort_col: str | None = None, order: str | None = "asc", tie: str = "brnumber",
          collation: str | None = None, ranges: int | None = None, id_col: str = "id") -> dict:
    """Sort ``rows`` into ranges under ``root`` and commit the index there. ``ranges``:
    how many (by default Spark's shuffle partitions, small ones put together)."""
    spark = rows.sparkSession
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    if collation and dict(rows.dtypes).get(sort_col) != "string":
        collation = None
    by = BR._sort_cols(sort_col, order, tie, collation)
    ordered = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    (ordered.sortWithinPartitions(*by).withColumn("_place", place).withColumn("_range", F.spark_partition_id())
     .write.partitionBy("_range").parquet(path))
    marks = T.StructType([rows.schema[id_col], T.StructField("_range", T.LongType())])
    counts = (spark.read.schema(marks).parquet(path).groupBy("_range")
              .agg(F.count(F.lit(1)).alias("n"), F.count(id_col).alias("ids")).orderBy("_range").collect())
    index = {"path": path, "ranges": [[r["_range"], r["n"]] for r in counts], "total": sum(r["ids"] for r in counts)}
    if not TB.create_if_absent(spark, f"{root.rstrip('/')}/index.json", json.dumps(index)):
        return read_index(spark, root)              # another one was first
    return index


def read_index(spark: SparkSession, root: str) -> dict | None:
    text = TB.read_text_file(spark, f"{root.rstrip('/')}/index.json")
    return json.loads(text) if text else None


def read_page(spark: SparkSession, index: dict, schema: T.StructType, page_no: int,
              page_size: int = BR.DEFAULT_PAGE_SIZE) -> DataFrame:
    """The page's rows in order, from the ranges that hold them, with ``total_pdfs``."""
    if page_no < 1:
        raise BR.QueryError(S.MSG_BAD_PAGE)
    first = (page_no - 1) * page_size
    ends = list(accumulate(n for _, n in index["ranges"]))
    placed = T.StructType([*schema.fields, T.StructField("_place", T.LongType())])
    out = spark.createDataFrame([], placed).withColumn("_range", F.lit(0))
    for (number, n), end in zip(index["ranges"], ends):
        low, high = max(first - (end - n), 0), min(first + page_size - (end - n), n)
        if low < high:
            part = spark.read.schema(placed).parquet(f"{index['path']}/_range={number}")
            out = out.unionByName(part.where((F.col("_place") >= low) & (F.col("_place") < high))
                                  .withColumn("_range", F.lit(number)))
    return (out.orderBy("_range", "_place").drop("_range", "_place")
            .withColumn("total_pdfs", F.lit(index["total"]).cast("long")))


def query_catalog_indexed(catalog: DataFrame, version: str, root: str, filters: str | Mapping | None = None,
                          sort_col: str | None = None, order: str | None = "asc", page_no: int = 1,
                          page_size: int = BR.DEFAULT_PAGE_SIZE, tie: str = "brnumber", collation: str | None = None,
                          ranges: int | None = None) -> DataFrame:
    """E5 with an index kept under ``root``. ``version`` names the state of ``catalog``
    (its commit number): a later state has indexes of its own."""
    if page_no < 1:
        raise BR.QueryError(S.MSG_BAD_PAGE)
    spark = catalog.sparkSession
    query = json.dumps([str(version), BR.parse_filters(filters), sort_col, order == "asc", tie, collation], sort_keys=True)
    folder = f"{root.rstrip('/')}/{hashlib.sha256(query.encode()).hexdigest()[:32]}"
    index = read_index(spark, folder)
    if index is None:
        index = build(BR.filter_equals(catalog, filters, collation), folder, sort_col, order, tie, collation, ranges)
    return read_page(spark, index, catalog.schema, page_no, page_size)
