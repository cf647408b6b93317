"""Column expressions shared by the operators that run on DataFrame functions alone."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """Only A-Z to lower case (``lower`` also maps other scripts; it is the quick way
    for a text of ASCII characters alone)."""
    return (F.when(F.length(text) == F.octet_length(text), F.lower(text))
            .otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase)))


def find_all(text: Column, pattern: str) -> Column:
    """All matches; an empty array for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def indices(n: Column) -> Column:
    """0 .. n - 1, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def covered(spans: Column) -> Column:
    """Positions in the union of (start, end) structs, ends exclusive."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["reach"]))).alias("n"),
        F.greatest(acc["reach"], s["end"]).alias("reach"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def join_documents(left, right, how: str):
    """Joins on (doc_id, text_key); null ids are equal to one another."""
    right = right.withColumnsRenamed({"doc_id": "right_id", "text_key": "right_key"})
    on = left["doc_id"].eqNullSafe(right["right_id"]) & (left["text_key"] == right["right_key"])
    return left.join(right, on, how).drop("right_id", "right_key")
