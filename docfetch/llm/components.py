"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfetch.llm.chunks import stored


def components(links: DataFrame, compression: str = "zstd") -> DataFrame:
    """(node, component): every node of the links (a, b) with the least node it reaches.

    Each round links every node's larger neighbours to its least neighbour, then its
    smaller ones; rounds grow with the logarithm of the number of nodes. Minima are
    aggregates joined back, so no node's neighbours meet in one task's memory.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), "edges", compression)
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.withColumnRenamed("m", "v")).distinct())
        edges = stored(small, "edges", compression)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    tops = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        tops.select(F.col("v").alias("node"), F.col("v").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    """Two equal edge tables have one mark."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
