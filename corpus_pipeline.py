"""The corpus pipeline: classify, join near duplicates, decontaminate, redact, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; ``run``
writes each stage's rows as Parquet and rereads them as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfetch.llm import bpe, decontaminate, jaccard_join, pii, queries, weak_quality
from docfetch.session import scratch_path

#: No SQL states the fitted classifier or the merges of the encoder; tests/llm has brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier accepts."""
    judged = weak_quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("quality_accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five-word shingles, similarity 0.8) the document
    with the least id (nulls last, then the least text key); documents without a word link
    with nothing and stay."""
    found = jaccard_join.groups(docs, n=5, num=80)
    kept = (found.where("n_shingles > 0").groupBy("group_key")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("kept"))
            .select("kept.doc_id", "kept.text_key"))
    keyed = docs.withColumn("pipeline_key", F.concat_ws(":", "doc_id", F.xxhash64("text")))
    kept = kept.select(F.concat_ws(":", "doc_id", "text_key").alias("pipeline_key"))
    words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return (keyed.where(words).join(kept, "pipeline_key", "left_semi").dropDuplicates(["pipeline_key"])
            .unionByName(keyed.where(~F.coalesce(words, F.lit(False)))).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that share a window with the benchmark."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_key=True)
    leaks = found.where("n_hit > 0").select("doc_id", "text_key").distinct()
    keyed = docs.withColumn("pipeline_key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
                                                        F.xxhash64("text")))
    leaks = leaks.select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_key")
                         .alias("pipeline_key"))
    return keyed.join(leaks, "pipeline_key", "left_anti").select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    found = pii.find_pii(docs)
    text = F.when(F.col("text").isNotNull(), pii.redact(F.col("text"), F.col("pii")))
    return (found.withColumn("text", text).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
            .select(*docs.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the hash of what they decode to."""
    ranks, pattern = queries.vocabulary(spark)
    coded = bpe.encode_and_decode(docs, ranks, pattern)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("private_data", private_data), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
