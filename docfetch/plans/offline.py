"""Outcomes when the bodies were already fetched into a table (a crawl store).

The fetch rows of a plan are judged by the signature of the stored body
instead of a network call; rows the plan settled keep their decision. The
body is reduced to one boolean before the join, so the shuffle carries a flag,
not the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfetch import schemas as S
from docfetch.operators.fetch import check_signature


def outcomes_from_payload(plan: DataFrame, payload: DataFrame, dest: str, key: str = "row_no",
                          content_col: str = "content", signature: bytes = S.PDF_SIGNATURE) -> DataFrame:
    flags = check_signature(payload.select(key, content_col), content_col, signature).select(key, "signature_ok")
    j = plan.join(flags, key, "left")
    fetch = F.col("decision") == "fetch"
    ok = F.coalesce(F.col("signature_ok"), F.lit(False))
    return (j.withColumn("outcome", F.when(~fetch, F.col("decision"))
                         .when(ok, F.lit("successful")).otherwise(F.lit("failed")))
            .withColumn("message", F.when(~fetch, F.col("message"))
                        .when(ok, F.lit(S.MSG_DOWNLOADED)).otherwise(F.lit(S.MSG_NOT_PDF)))
            .withColumn("file_folder", F.when(~fetch, F.col("file_folder")).otherwise(F.lit(dest)))
            .withColumn("attempt", F.lit(1))
            .drop("signature_ok"))
