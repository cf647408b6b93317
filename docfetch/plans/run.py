"""One run of a manifest: plan -> fetch (waves, then backup URLs) -> catalog.

The plan is one lazy Spark plan. Fetching has side effects, so each fetch pass
is materialised exactly once (``persist``, by default a Parquet write under the
shared checkpoint folder) and everything after it reads that copy; a lost
executor or a second action never repeats a download.

Duplicates of one raw file name ending in ``.pdf`` (so stored under the same
name) are fetched in two waves: the first row per name (by ``row_no``) in wave 1;
later rows of a name a wave-1 row stored are ``already_downloaded``, the others
are fetched in wave 2. A hot name therefore costs one fetch, not one task
holding all its rows. Other rows of one URL and stored name share the download of the
first of them (``operators.fetch.share_downloads``); if that one failed, they are fetched
in wave 2, each on its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfetch import schemas as S
from docfetch.operators import catalog as CA
from docfetch.operators import fetch as FE
from docfetch.operators import runs as RU
from docfetch.operators.keys import flag_extreme_per_key, keep_extreme_per_key, presence_flag
from docfetch.plans import fetch_plan as FP

ATTEMPT_COLS = ["row_no", "attempt", "url", "stored_name", "file_folder", "outcome", "message", "finished_at"]


class Stop(Protocol):
    def stopped(self) -> bool:
        """Shall the run end?"""

    def settle(self) -> None:
        """Fetching is over: what follows (storing the attempts) must not be interrupted."""


@dataclass
class RunResult:
    plan: DataFrame
    attempts: DataFrame          # one row per row and URL tried
    updates: DataFrame           # catalog rows written by this run (one per manifest row)
    catalog: DataFrame           # catalog after the upsert
    counts: DataFrame            # reference counters (attempt 1)
    totals: DataFrame            # counters on the last attempt per row


def run_manifest(manifest: DataFrame, files: DataFrame, catalog: DataFrame, dest: str, now, run_id: int = 0,
                 signature: bytes = S.PDF_SIGNATURE, timeout: float = 10.0,
                 num_partitions: int | None = None, persist=None, use_backup: bool = True,
                 concurrency: int = 8, host_slots: int | None = None,
                 progress: Callable[[DataFrame], None] | None = None, stop: Stop | None = None) -> RunResult:
    """``manifest``: mapped manifest rows (B2) with a unique ``row_no``;
    ``files``: listing of ``dest`` (``file_name``); ``catalog``: current catalog.
    ``num_partitions``, ``concurrency`` and ``host_slots`` shape the fetch (see
    ``fetch_documents``). ``progress`` gets the attempts so far after each wave.
    ``stop`` ends the fetching early: no further wave begins, a wave that is interrupted
    is given up, and the result is that of the waves before."""
    persist = persist or FE.persist_attempts
    report = progress or (lambda attempts: None)

    def fetch(rows, url_col):
        return FE.fetch_documents(rows, url_col, dest, signature, timeout, num_partitions,
                                  concurrency=concurrency, host_slots=host_slots)

    now_col = FP._now_literal(now)
    FE.prepare_folder(dest)
    plan = persist(FP.plan_fetch(manifest, files, catalog, dest))
    repeated = plan.groupBy("row_no").count().where("count > 1").select("row_no").first()
    if repeated is not None:      # positions join everything below: never fetch on ambiguous ones
        raise ValueError(f"row_no {repeated['row_no']} occurs more than once in the manifest")

    decided = (plan.where(F.col("decision") != "fetch")
               .select("row_no", F.lit(1).alias("attempt"), F.col("pdf_url").alias("url"), "stored_name",
                       "file_folder", F.col("decision").alias("outcome"), "message",
                       now_col.alias("finished_at")))

    fetch_rows = plan.where(F.col("decision") == "fetch")
    exact_pdf = F.col("file_name").endswith(S.PDF_SUFFIX)
    fetch_rows = fetch_rows.withColumn("_url", F.when(exact_pdf, F.lit("")).otherwise(F.col("pdf_url")))
    fetch_rows = flag_extreme_per_key(fetch_rows, ["stored_name", "_url"], "row_no", "_first").drop("_url")
    wave1 = fetch_rows.where(F.col("_first"))
    wave2 = fetch_rows.where(~F.col("_first") & exact_pdf)
    same_url = fetch_rows.where(~F.col("_first") & ~exact_pdf)

    def waves():
        """The attempts so far, wave by wave."""
        a1 = persist(fetch(wave1, "pdf_url")
                     .withColumn("attempt", F.lit(1)).withColumn("file_folder", F.lit(dest)))
        yield decided.unionByName(a1.select(*ATTEMPT_COLS))
        stored = a1.where(F.col("outcome") == "successful").select("stored_name")
        w2 = presence_flag(wave2, stored, ["stored_name"], "_stored")   # wave 2 holds the hot names
        w2_done = (w2.where(F.col("_stored"))
                   .select("row_no", F.lit(1).alias("attempt"), F.col("pdf_url").alias("url"), "stored_name",
                           F.lit(dest).alias("file_folder"), F.lit("already_downloaded").alias("outcome"),
                           F.lit(S.MSG_EXISTS_IN_FOLDER).alias("message"), now_col.alias("finished_at")))
        shared, others = FE.share_downloads(same_url, a1)
        asked = ["row_no", "pdf_url", "stored_name"]
        again = w2.where(~F.col("_stored")).select(*asked).unionByName(others.select(*asked))
        a2 = persist(fetch(again, "pdf_url").withColumn("attempt", F.lit(1)).withColumn("file_folder", F.lit(dest)))
        first = (decided.unionByName(a1.select(*ATTEMPT_COLS)).unionByName(w2_done)
                 .unionByName(shared.select(*ATTEMPT_COLS)).unionByName(a2.select(*ATTEMPT_COLS)))
        yield first
        if use_backup:
            yield FE.fetch_with_backup(plan, dest=dest, signature=signature, timeout=timeout,
                                       num_partitions=num_partitions, persist=persist, concurrency=concurrency,
                                       host_slots=host_slots, first=first, files=files, now=now_col)

    attempts = decided
    stopped = stop.stopped if stop else lambda: False
    try:
        if not stopped():
            for n, attempts in enumerate(waves()):
                if n < 2:
                    report(attempts)
                if stopped():
                    break
    except Exception:
        if not stopped():             # else the wave was interrupted: the attempts before it stand
            raise
    if stop:
        stop.settle()

    attempts = attempts.withColumn("run_id", F.lit(run_id).cast("long"))
    last = keep_extreme_per_key(attempts, ["row_no"], "attempt", last=True)
    outcomes = (plan.drop("stored_name", "file_folder", "message")
                .join(last.select("row_no", "stored_name", "file_folder", "outcome", "message"), "row_no"))
    updates = persist(FP.shape_result(outcomes, now))     # a commit may have to apply them again
    new_catalog = CA.upsert(catalog, updates)
    counts = RU.outcome_counts(attempts.where(F.col("attempt") == 1))
    totals = RU.outcome_counts(last)
    return RunResult(plan, attempts, updates, new_catalog, counts, totals)
