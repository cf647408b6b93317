"""Manifest preparation: slice, map, validate, de-duplicate, derive names (B1-B10)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfetch import schemas as S
from docfetch.functions import columns as C
from docfetch.operators.keys import flag_extreme_per_key, presence_flag


# B1
def slice_rows(df: DataFrame, start_row: int | None = 0, num_rows: int | None = None,
               row_col: str = "row_no") -> DataFrame:
    """Skip ``start_row`` data rows and keep ``num_rows`` in file order; 0 or None
    keeps all the rest. A filter on the position set at read time, so it needs
    no ordering shuffle (``limit`` has no order); on a stored position column it
    pushes into the scan, on one just numbered by a reader it cannot."""
    start = int(start_row or 0)
    cond = F.col(row_col) >= F.lit(start)
    if num_rows:
        cond = cond & (F.col(row_col) < F.lit(start + int(num_rows)))
    return df.where(cond)


# B2
def map_columns(df: DataFrame, mapping: Mapping[str, str] = S.MANIFEST_COLUMN_MAP,
                default: str | None = "", keep: Sequence[str] = ("row_no", "source_file")) -> DataFrame:
    """Rename manifest headers to catalog names; a header missing from the file
    becomes the ``default`` text (a present but empty cell stays NULL)."""
    cols: list[Column] = [F.col(k) for k in keep if k in df.columns]
    for src, dst in mapping.items():
        if src in df.columns:
            cols.append(F.col(f"`{src}`").alias(dst))
        else:
            cols.append(F.lit(default).cast("string").alias(dst))
    return df.select(*cols)


def manifest_key_rules() -> list[tuple[Column, str]]:
    """Rules a manifest row must pass before a run: its file could be read and
    has the required headers (needs ``read_error`` and ``missing_columns``, see
    ``read_manifests``), and the catalog key is NOT NULL and String(50)."""
    unreadable = (F.col("read_error").isNotNull(), "manifest file could not be read")
    missing = (F.size("missing_columns") > 0,
               "manifest lacks required column(s): " + ", ".join(S.REQUIRED_MANIFEST_COLUMNS))
    return [unreadable, missing, C.not_null_rule("brnumber"), C.max_length_rule("brnumber", 50)]


def require_columns(df: DataFrame, required: Sequence[str] = S.REQUIRED_MANIFEST_COLUMNS) -> DataFrame:
    """Fail up front (driver side, schema only) when a required header is absent."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"manifest lacks required column(s): {', '.join(missing)}")
    return df


# B3
def with_errors(df: DataFrame, rules: Sequence[tuple[Column, str]], errors: str = "errors") -> DataFrame:
    """Add ``errors ARRAY<STRING>``: the message of every violated rule, in rule order."""
    checks = [F.when(cond, F.lit(msg)) for cond, msg in rules]
    return df.withColumn(errors, F.array_compact(F.array(*checks)))


def validate_rows(df: DataFrame, rules: Sequence[tuple[Column, str]],
                  errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their ``errors``)."""
    flagged = with_errors(df, rules, errors)
    ok = F.size(errors) == 0
    return flagged.where(ok).drop(errors), flagged.where(~ok)


# B4
def normalise_key(df: DataFrame, col: str) -> DataFrame:
    """Keys stored lower-case (user names)."""
    return df.withColumn(col, F.lower(F.col(col)))


# B5
def flag_duplicates(new: DataFrame, keys: Sequence[str], messages: Sequence[str],
                    order: str = "row_no", existing: DataFrame | None = None,
                    reason: str = "reject_reason") -> DataFrame:
    """Add ``reject_reason``: for each unique key in turn, its message when the key
    is already in ``existing`` or an earlier row (by ``order``) of the batch has
    it; NULL when the row can be inserted. Each key is judged on its own (see
    ``flag_duplicates_sequential`` for one-at-a-time inserts). ``existing`` is
    unique on each of the keys."""
    out = new
    reason_col = F.lit(None).cast("string")
    conds = []
    for i, (key, msg) in enumerate(zip(keys, messages)):
        first_flag, exist_flag = f"_first_{i}", f"_exists_{i}"
        out = flag_extreme_per_key(out, [key], order, first_flag)
        taken = ~F.col(first_flag)
        if existing is not None:
            out = presence_flag(out, existing, [key], exist_flag, unique=True)
            taken = taken | F.col(exist_flag)
        conds.append((taken, msg))
    for taken, msg in reversed(conds):
        reason_col = F.when(taken, F.lit(msg)).otherwise(reason_col)
    drop = [c for c in out.columns if c.startswith("_first_") or c.startswith("_exists_")]
    return out.withColumn(reason, reason_col).drop(*drop)


def reject_duplicates(new: DataFrame, keys: Sequence[str], messages: Sequence[str],
                      order: str = "row_no", existing: DataFrame | None = None
                      ) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reject_reason``)."""
    flagged = flag_duplicates(new, keys, messages, order, existing)
    return (flagged.where(F.col("reject_reason").isNull()).drop("reject_reason"),
            flagged.where(F.col("reject_reason").isNotNull()))


# B6
def derive_file_name(df: DataFrame, url_col: str = "pdf_url", out: str = "file_name") -> DataFrame:
    return df.withColumn(out, C.base_name(url_col))


# B7
def flag_supported(files: DataFrame, name_col: str = "file_name",
                   allowed: Sequence[str] = S.RUN_EXTENSIONS, mode: str = "run") -> DataFrame:
    """Add ``extension`` and ``supported``. ``run`` mode takes the extension the
    way ``os.path.splitext`` does (dot included); ``upload`` mode takes the text
    after the last dot."""
    ext = C.path_extension(name_col) if mode == "run" else C.last_dot_piece(name_col)
    return (files.withColumn("extension", ext)
            .withColumn("supported", F.coalesce(F.col("extension").isin(list(allowed)), F.lit(False))))


def filter_supported(files: DataFrame, name_col: str = "file_name",
                     allowed: Sequence[str] = S.RUN_EXTENSIONS, mode: str = "run"
                     ) -> tuple[DataFrame, DataFrame]:
    flagged = flag_supported(files, name_col, allowed, mode)
    return flagged.where("supported"), flagged.where("NOT supported")


# B8
def explode_candidates(df: DataFrame, url_cols: Sequence[str] = ("pdf_url", "pdf_backup_url"),
                       url: str = "url", attempt: str = "attempt") -> DataFrame:
    """One row per (row, candidate URL); ``attempt`` is 1-based, ``url_source``
    names the column the URL came from. NULL URLs are kept (they fail later)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("src"), F.col(c).alias("u")) for c in url_cols])
    rest = [c for c in df.columns]
    return (df.select(*rest, F.posexplode(pairs).alias("_pos", "_cand"))
            .select(*rest, (F.col("_pos") + 1).cast("int").alias(attempt),
                    F.col("_cand.src").alias("url_source"), F.col("_cand.u").alias(url)))


# B9
def require_pdf_suffix(df: DataFrame, name_col: str = "file_name", flag: str = "pdf_suffix_ok") -> DataFrame:
    """The earlier script fails any URL whose name does not end in .pdf (any case)."""
    return df.withColumn(flag, F.coalesce(C.has_pdf_suffix(name_col), F.lit(False)))


# B10
def register_manifests(new: DataFrame, registry: DataFrame, overwrite: bool = False,
                       name_col: str = "file_name", order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Admit uploaded manifests into the registry of stored lists.

    Returns (registry after the upload, uploads with ``decision`` / ``message``).
    Without ``overwrite`` a name already stored (or uploaded earlier in the same
    batch) is refused; with it the latest upload of a name replaces the stored one.
    Only ``xlsx``/``xls`` uploads are admitted.
    """
    flagged = flag_supported(new, name_col, S.UPLOAD_EXTENSIONS, mode="upload")
    flagged = flag_extreme_per_key(flagged, [name_col], order, "_first", last=overwrite)
    flagged = presence_flag(flagged, registry, [name_col], "_stored")
    decision = (F.when(~F.col("supported"), F.lit("refused"))
                .when(~F.col("_first"), F.lit("superseded" if overwrite else "refused"))
                .when(F.col("_stored") & F.lit(not overwrite), F.lit("refused"))
                .otherwise(F.lit("stored")))
    exists_msg = F.format_string(S.MSG_FILE_EXISTS.replace("{name}", "%s"), F.col(name_col))
    message = (F.when(~F.col("supported"), F.lit(S.MSG_INVALID_UPLOAD))
               .when(~F.col("_first") & F.lit(not overwrite), exists_msg)
               .when(F.col("_stored") & F.lit(not overwrite), exists_msg))
    decided = (flagged.withColumn("decision", decision).withColumn("message", message)
               .drop("_first", "_stored", "extension", "supported"))
    stored = decided.where(F.col("decision") == "stored").drop("decision", "message")
    keep_cols = registry.columns
    if overwrite:
        kept = registry.join(stored.select(name_col), name_col, "left_anti")
    else:
        kept = registry
    updated = kept.unionByName(stored.select(*[c for c in keep_cols if c in stored.columns]),
                               allowMissingColumns=True)
    return updated, decided


def flag_duplicates_sequential(new: DataFrame, keys: Sequence[str], messages: Sequence[str],
                               order: str = "row_no", existing: DataFrame | None = None,
                               reason: str = "reject_reason") -> DataFrame:
    """B5 with the semantics of inserting the rows one at a time in ``order``: a row
    is accepted unless an *accepted* earlier row (or ``existing``) already holds
    one of its unique keys; the reason names the first such key in ``keys`` order.

    Iterative and distributed. In a round, an undecided row without an earlier undecided
    row on any of its keys is accepted. A row with exactly one such blocker is accepted
    if and only if its blocker is not, so chains of such rows are decided at once by
    pointer jumping (``_even_links``): a chain of n rows costs log(n) joins, not n rounds.
    Then all rows that share a key with an accepted one are rejected. Rows with several
    undecided blockers wait for the next round; only where these depend on each other in
    turn do rounds add up. Every round decides at least the earliest undecided row. Rows
    with a NULL key never collide on that key.
    """
    from docfetch.session import checkpoint_root

    keys = list(keys)
    checkpoint_root(new.sparkSession)
    base = new.select(order, *keys)
    pre_taken = F.lit(False)
    if existing is not None:
        for i, k in enumerate(keys):
            base = presence_flag(base, existing, [k], f"_ex_{i}", unique=True)
            pre_taken = pre_taken | F.col(f"_ex_{i}")
    undecided = base.where(~pre_taken).select(order, *keys).checkpoint()
    accepted = undecided.limit(0)
    while True:
        linked = _blockers(undecided, keys, order).checkpoint()
        n_rows, n_linked = linked.agg(F.count(F.lit(1)), F.count_if(F.col("_state") == "one")).first()
        if not n_rows:
            break
        winners = linked.where(F.col("_state") == "none").select(order, *keys)
        if n_linked:
            even = _even_links(linked, order)
            winners = winners.unionByName(linked.join(even, order, "left_semi").select(order, *keys))
        winners = winners.checkpoint()
        accepted = accepted.unionByName(winners).checkpoint()   # lineage stays one step long
        if not n_linked and winners.count() == n_rows:
            break
        rest = undecided.join(winners.select(order), order, "left_anti")
        hit = F.lit(False)
        for i, k in enumerate(keys):
            rest = presence_flag(rest, winners, [k], f"_hit_{i}", unique=True)
            hit = hit | F.col(f"_hit_{i}")
        undecided = rest.where(~hit).select(order, *keys).checkpoint()

    accepted = accepted.select(order, *keys).withColumn("_accepted", F.lit(True))
    out = new.join(accepted.select(order, "_accepted"), order, "left")
    reason_col = F.lit(None).cast("string")
    conds = []
    for i, (k, msg) in enumerate(zip(keys, messages)):
        # at most one accepted row holds each key value: its position decides
        holder = accepted.where(F.col(k).isNotNull()).select(F.col(k), F.col(order).alias(f"_by_{i}"))
        out = out.join(holder, k, "left")
        taken = F.coalesce(F.col(f"_by_{i}") < F.col(order), F.lit(False))
        if existing is not None:
            out = presence_flag(out, existing, [k], f"_ex_{i}", unique=True)
            taken = taken | F.col(f"_ex_{i}")
        conds.append(taken & F.col("_accepted").isNull())
    for taken, msg in reversed(list(zip(conds, messages))):
        reason_col = F.when(taken, F.lit(msg)).otherwise(reason_col)
    drop = [c for c in out.columns if c.startswith(("_by_", "_ex_")) or c == "_accepted"]
    return out.withColumn(reason, reason_col).drop(*drop)


def _blockers(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds ``_state`` - does a row have none, one or many earlier rows on its keys? - and
    ``_at``, the one. Of a key's rows only the second has exactly one before it. Joins are
    on (key, order), so a hot value is spread like any other."""
    found, later = [], F.lit(False)
    for i, k in enumerate(keys):
        first = rows.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias("_first"))
        rows = rows.join(first.withColumn(order, F.col("_first")).withColumnRenamed("_first", f"_first_{i}"), [k, order], "left")
        behind = rows.where(F.col(f"_first_{i}").isNull() & F.col(k).isNotNull())
        second = behind.groupBy(k).agg(F.min(order).alias(order)).join(first.withColumnRenamed("_first", f"_at_{i}"), k)
        rows = rows.join(second, [k, order], "left")
        found.append(F.col(f"_at_{i}"))
        later = later | (F.col(k).isNotNull() & F.col(f"_first_{i}").isNull() & F.col(f"_at_{i}").isNull())
    blockers = F.array_distinct(F.array_compact(F.array(*found)))
    state = F.when(later | (F.size(blockers) > 1), "many").when(F.size(blockers) == 1, "one").otherwise("none")
    return rows.select(order, *keys, state.alias("_state"), F.when(state == "one", blockers[0]).alias("_at"))


def _even_links(linked: DataFrame, order: str) -> DataFrame:
    """``order`` of the rows an even number of links behind a row that is accepted. Each step
    replaces a row's pointer by its pointer's pointer, so distances double."""
    links = linked.where(F.col("_state") == "one").select(order, "_at", F.lit(True).alias("_odd"),
                                                          F.lit(False).alias("_end"))
    while True:
        step = links.select(F.col(order).alias("_of"), F.col("_at").alias("_next"), F.col("_odd").alias("_more"))
        moving = links.where(~F.col("_end")).join(step, F.col("_at") == F.col("_of"), "left")
        moved = moving.select(order, F.coalesce("_next", "_at").alias("_at"),
                              (F.col("_odd") != F.coalesce("_more", F.lit(False))).alias("_odd"),
                              F.col("_of").isNull().alias("_end"))
        links = links.where("_end").unionByName(moved).checkpoint()
        if links.where(~F.col("_end")).isEmpty():
            break
    heads = linked.where(F.col("_state") == "none").select(F.col(order).alias("_head"))
    return links.where(~F.col("_odd")).join(heads, F.col("_at") == F.col("_head"), "left_semi").select(order)
