"""Run tracking: aggregates over the attempts log and the runs table (F1-F10).

Counters are grouped aggregates (partial + final hash aggregation, so a run
holding a third of all attempts is combined map-side). Running counters are a
two-level prefix sum: rows are range-partitioned on (run, time, sequence) into
slices of equal size, each slice is scanned by its own task, and the slice
totals - a small table, one row per run and slice - supply each slice's
starting offset. No window ever holds a whole run.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfetch import schemas as S
from docfetch.functions import columns as C
from docfetch.session import scratch_path

COUNTERS = ("successful", "already_downloaded", "failed")


def _ts(now) -> Column:
    if isinstance(now, Column):
        return now
    if isinstance(now, dt.datetime):
        now = now.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(now)).cast("timestamp_ntz")


def epoch_seconds(ts: str | Column) -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            col.cast("timestamp_ntz"))


# F1
def outcome_counts(attempts: DataFrame, by: str = "run_id", outcome: str = "outcome",
                   attempts_to_count: str = "all") -> DataFrame:
    """Per run: successful / already_downloaded / failed / processed_rows.

    ``attempts_to_count``: ``all`` rows as given; ``first`` only attempt 1 (the
    numbers the original reports, where a rescued row still counts as failed);
    ``last`` the last attempt per row (true totals)."""
    if attempts_to_count == "first" and "attempt" in attempts.columns:
        attempts = attempts.where(F.col("attempt") == 1)
    elif attempts_to_count == "last" and "attempt" in attempts.columns:
        from docfetch.operators.keys import keep_extreme_per_key
        attempts = keep_extreme_per_key(attempts, [by, "row_no"], "attempt", last=True)
    o = F.col(outcome)
    return attempts.groupBy(by).agg(
        *[F.count_if(o == k).alias(k) for k in COUNTERS],
        F.count(F.lit(1)).alias("processed_rows"))


# F2
def running_counts(attempts: DataFrame, by: str = "run_id", ts: str = "finished_at", seq: str = "seq",
                   outcome: str = "outcome", slices: int | None = None) -> DataFrame:
    """Counters after every finished row, in (``ts``, ``seq``) order per run.

    Rows are range-partitioned on (run, time, seq) into ``slices`` ranges of about
    equal size (default: the shuffle partitions), so a burst of rows with one
    time stamp is cut like any other. Each range is scanned by its own task; the
    totals per run and range - at most runs + ranges rows - give every range its
    starting offset. The ranges are written once to the shared folder: both uses
    must see the same cuts. A NULL run is a run, a NULL time comes first."""
    spark = attempts.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = F.col(outcome)
    names = list(COUNTERS) + ["processed_rows"]
    one = {k: F.coalesce(o == k, F.lit(False)).cast("long") for k in COUNTERS}
    one["processed_rows"] = F.lit(1).cast("long")
    path = scratch_path(spark, "running-counts")
    (attempts.repartitionByRange(n, by, ts, seq).withColumn("_b", F.spark_partition_id()).write.parquet(path))
    x = spark.read.schema(attempts.withColumn("_b", F.lit(0)).schema).parquet(path)
    x = x.withColumns({f"_i_{k}": c for k, c in one.items()})

    totals = x.groupBy(by, "_b").agg(*[F.sum(f"_i_{k}").alias(f"_t_{k}") for k in names])
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(by).alias("_run"), F.col("_b").alias("_range"),
                            *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in names])
    within = Window.partitionBy(by, "_b").orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, 0)
    y = x.select(*attempts.columns, "_b", *[F.sum(f"_i_{k}").over(within).alias(f"_r_{k}") for k in names])
    z = y.join(offsets, F.col(by).eqNullSafe(F.col("_run")) & (F.col("_b") == F.col("_range")))
    return z.select(*attempts.columns, *[(F.col(f"_r_{k}") + F.col(f"_o_{k}")).alias(k) for k in names])


# F3
def sample_progress(attempts: DataFrame, seconds: int = 1, by: str = "run_id", ts: str = "finished_at",
                    seq: str = "seq", **kw) -> DataFrame:
    """Running counters kept at most once per ``seconds`` slot per run (the last
    row of the slot); the run's final row is always the last of its slot."""
    counts = running_counts(attempts, by, ts, seq, **kw)
    slot = F.floor(epoch_seconds(ts) / F.lit(seconds))
    return (counts.groupBy(by, slot.alias("_slot"))
            .agg(F.max_by(F.struct(*counts.columns), F.struct(ts, seq)).alias("_w"))
            .select(*[F.col("_w").getField(c).alias(c) for c in counts.columns]))


def sample_elapsed(attempts: DataFrame, seconds: float = 1, starts: DataFrame | None = None, by: str = "run_id",
                   ts: str = "finished_at", seq: str = "seq", start_col: str = "start_time", **kw) -> DataFrame:
    """Running counters as the original stored them: a row is kept when at least ``seconds``
    have passed since the last kept one (the first: since the run's start, ``starts`` or
    its first attempt), and the run's last row always. Rows without a time are counted,
    not kept.

    Which rows are kept is a chain: each names the next, the first row so much later. The
    next row of every row is a running count (rows before that moment, plus one), and the
    chain from a run's start is followed by doubled steps: with pointers over 1, 2, 4 ...
    links at hand, the rows reached so far double with each join. So a run of n kept rows
    costs 2 log(n) joins, on unique (run, position) pairs, and no task holds a run."""
    counts = running_counts(attempts, by, ts, seq, **kw)
    counts = _written(counts.withColumn("_rank", F.col("processed_rows")), "sampled-counts")
    timed = counts.where(F.col(ts).isNotNull())
    if starts is None:
        starts = timed.groupBy(by).agg(F.min(ts).alias(start_col))
    later = F.make_dt_interval(secs=F.lit(seconds))
    # probes stand before the rows of their moment: a probe's count is of the rows before it
    place = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col("_rank").alias("rank"))
    row = timed.select(by, F.col(ts).alias("_t"), place(1).alias("_pos"), F.lit("successful").alias("_row"))
    probes = timed.select(by, ts, "_rank").unionByName(
        starts.select(by, F.col(start_col).cast("timestamp_ntz").alias(ts), F.lit(0).cast("long").alias("_rank")))
    probes = probes.select(by, (F.col(ts) + later).alias("_t"), place(0).alias("_pos"), F.lit(None).cast("string").alias("_row"))
    # NULL times come first and were counted, so ranks go on behind them
    untimed = counts.where(F.col(ts).isNull()).groupBy(by).agg(F.count(F.lit(1)).alias("_untimed"))
    links = running_counts(row.unionByName(probes), by, "_t", "_pos", "_row", **kw).where("_pos.kind = 0")
    links = (links.join(untimed.withColumnRenamed(by, "_of"), F.col(by).eqNullSafe(F.col("_of")), "left")
             .select(F.col(by).alias("_run"), F.col("_pos.rank").alias("_from"),
                     (F.col("successful") + F.coalesce("_untimed", F.lit(0)) + 1).alias("_to")))
    last = counts.groupBy(by).agg(F.max("_rank").alias("_last"))
    links = (links.join(last.withColumnRenamed(by, "_of"), F.col("_run").eqNullSafe(F.col("_of")))
             .where(F.col("_to") <= F.col("_last")).select("_run", "_from", "_to"))
    reached = links.select("_run", F.col("_to").alias("_from")).distinct()   # only rows that a link leads to
    links = _written(links.where("_from = 0").unionByName(_met(links.where("_from > 0"), reached, "left_semi")), "links")

    steps = [links]
    while True:
        one, two = steps[-1], steps[-1].select(F.col("_run").alias("_r"), F.col("_from").alias("_f"), F.col("_to").alias("_t"))
        longer = one.join(two, F.col("_run").eqNullSafe(F.col("_r")) & (F.col("_to") == F.col("_f")))
        longer = _written(longer.select("_run", "_from", F.col("_t").alias("_to")), "links")
        if longer.where("_from = 0").isEmpty():        # no chain is that long
            break
        steps.append(longer)
    kept = links.where("_from = 0").select("_run", "_from")
    for step in reversed(steps):
        onward = _met(step, kept, "left_semi").select("_run", F.col("_to").alias("_from"))
        kept = _written(kept.unionByName(onward), "kept")
    kept = kept.unionByName(last.select(F.col(by).alias("_run"), F.col("_last").alias("_from"))).distinct()
    names = [c for c in counts.columns if c != "_rank"]
    return counts.join(kept, F.col(by).eqNullSafe(F.col("_run")) & (F.col("_rank") == F.col("_from")), "left_semi").select(*names)


def _met(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Rows whose (_run, _from) the other side has; a NULL run is a run."""
    right = other.select(F.col("_run").alias("_r"), F.col("_from").alias("_f"))
    return rows.join(right, F.col("_run").eqNullSafe(F.col("_r")) & (F.col("_from") == F.col("_f")), how)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# F4
def progress_state(runs: DataFrame) -> DataFrame:
    """``progress`` = processed_rows / num_rows * 100 (NULL when num_rows is 0);
    ``state`` shows ``finalizing`` for a running task at exactly 100."""
    pct = F.try_divide(F.col("processed_rows").cast("double"),
                       F.when(F.col("num_rows") != 0, F.col("num_rows")).cast("double")) * F.lit(100.0)
    return (runs.withColumn("progress", pct)
            .withColumn("state", F.when((F.col("status") == "running") & (F.col("progress") == 100.0),
                                        F.lit("finalizing")).otherwise(F.col("status"))))


# F5
def run_duration(runs: DataFrame, now) -> DataFrame:
    """``running_seconds``: now - start while running, end - start otherwise;
    ``running_time`` as ``h hours, m minutes, s seconds``."""
    end = F.when(F.col("status") == "running", _ts(now)).otherwise(F.col("end_time"))
    secs = C.seconds_between(F.col("start_time"), end)
    return (runs.withColumn("running_seconds", secs)
            .withColumn("running_time", C.duration_text(F.col("running_seconds"))))


# F6
def pending_manifests(requests: DataFrame, runs: DataFrame, file_col: str = "running_file",
                      order: str = "seq") -> DataFrame:
    """A run request is refused while a run of the same file is ``running``; of
    several requests for a free file the first starts and the rest find it
    running. Adds ``decision`` (accepted / refused) and ``message``."""
    from docfetch.operators.keys import flag_extreme_per_key, presence_flag

    busy = runs.where(F.col("status") == "running").select(file_col)
    r = presence_flag(requests, busy, [file_col], "_busy")
    r = flag_extreme_per_key(r, [file_col], order, "_first")
    ok = ~F.col("_busy") & F.col("_first")
    return (r.withColumn("decision", F.when(ok, "accepted").otherwise("refused"))
            .withColumn("message", F.when(ok, F.lit(None).cast("string")).otherwise(F.lit(S.MSG_TASK_RUNNING)))
            .drop("_busy", "_first"))


# F7
def apply_cancels(runs: DataFrame, cancels: DataFrame, key: str = "task_id",
                  order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Cancel requests, in ``order``. Returns (runs after, requests with
    ``message``): the first request for a running task cancels it; any other
    request for a known task finds it finished; an unknown id has no task.
    Cancelled is terminal."""
    from docfetch.operators.keys import flag_extreme_per_key

    status = runs.select(key, F.col("status").alias("_status"))
    c = flag_extreme_per_key(cancels, [key], order, "_first").join(status, key, "left")
    msg = (F.when(F.col("_status").isNull(), F.lit(S.MSG_NO_SUCH_TASK))
           .when(F.col("_first") & (F.col("_status") == "running"), F.lit(S.MSG_TASK_CANCELLED))
           .otherwise(F.lit(S.MSG_TASK_FINISHED)))
    answered = c.withColumn("message", msg).drop("_first", "_status")
    hit = (cancels.select(key).distinct().withColumn("_cancel", F.lit(True)))
    after = (runs.join(hit, key, "left")
             .withColumn("status", F.when(F.col("_cancel") & (F.col("status") == "running"), F.lit("cancelled"))
                         .otherwise(F.col("status")))
             .drop("_cancel"))
    return after.select(*runs.columns), answered


# F8
def encode_results(counts: DataFrame, out: str = "results") -> DataFrame:
    return counts.withColumn(out, C.encode_results(*[F.col(k) for k in (*COUNTERS, "processed_rows")]))


def decode_results(df: DataFrame, col: str = "results", out: str = "decoded") -> DataFrame:
    return df.withColumn(out, C.decode_results(col))


# F9
def failed_by_subtraction(attempts: DataFrame, nrows: DataFrame, by: str = "run_id",
                          nrows_col: str = "num_rows") -> DataFrame:
    """The earlier script's rule: failed = rows - successful - already, where the
    two counts run over every URL tried (two per row), so it can go negative."""
    o = F.col("outcome")
    c = attempts.groupBy(by).agg(F.count_if(o == "successful").alias("successful"),
                                 F.count_if(o == "already_downloaded").alias("already_downloaded"))
    return (c.join(nrows.select(by, nrows_col), by)
            .withColumn("failed", F.col(nrows_col) - F.col("successful") - F.col("already_downloaded")))


# F10
def run_report(runs: DataFrame, attempts: DataFrame, now, key: str = "task_id", by: str = "run_id") -> DataFrame:
    """One record per run, any status (a cancelled run is reported too): status
    (finalizing shown), times, rows, file, counters as JSON. A run without any
    attempt reports zeros. Both join sides have one row per run."""
    counts = outcome_counts(attempts, by).select(F.col(by).alias(key), *COUNTERS, "processed_rows")
    r = run_duration(progress_state(runs), now)
    j = r.join(counts.withColumnRenamed("processed_rows", "_counted"), key, "left")
    zero = F.lit(0).cast("long")
    results = C.encode_results(*[F.coalesce(F.col(k), zero) for k in (*COUNTERS, "_counted")])
    return j.withColumn("results", results).drop(*COUNTERS, "_counted")
