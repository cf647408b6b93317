"""Column expressions (all JVM-side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docfetch import schemas as S


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- names and extensions -----------------------------------------------------

def base_name(url: str | Column) -> Column:
    """Last ``/``-separated piece of a URL (``u.split('/')[-1]``); '' for a trailing slash."""
    return F.substring_index(_c(url), "/", -1)


def stored_name(name: str | Column) -> Column:
    """Name a fetched file is written under: ``.pdf`` appended unless it already ends in
    ``.pdf`` (case-sensitive, so ``X.PDF`` becomes ``X.PDF.pdf``)."""
    n = _c(name)
    return F.when(n.endswith(S.PDF_SUFFIX), n).otherwise(F.concat(n, F.lit(S.PDF_SUFFIX)))


def has_pdf_suffix(name: str | Column) -> Column:
    """Name ends in ``.pdf`` in any case."""
    return F.lower(_c(name)).endswith(S.PDF_SUFFIX)


def path_extension(name: str | Column) -> Column:
    """``os.path.splitext`` extension, dot included; leading dots do not start one."""
    return F.regexp_extract(_c(name), r"^\.*[^.].*?(\.[^.]*)$", 1)


def last_dot_piece(name: str | Column) -> Column:
    """``name.split('.')[-1]``: the whole name when it has no dot."""
    return F.substring_index(_c(name), ".", -1)


def fill_template(template: str, **values: Column | str) -> Column:
    """``template`` with each ``{name}`` replaced by a column (or text), as one
    ``concat``. NULL values print as ``None``, as Python's f-strings do."""
    import re

    parts: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        v = values[m.group(1)]
        parts.append(F.coalesce(v, F.lit("None")) if isinstance(v, Column) else F.lit(str(v)))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


# --- run results JSON -----------------------------------------------------------

def encode_results(successful, already, failed, processed) -> Column:
    """Counters as JSON text in the layout Python's ``json.dumps`` writes
    (``{"successful": 1, ...}``), so stored texts stay byte-equal."""
    parts = [("successful", successful), ("already_downloaded", already),
             ("failed", failed), ("processed_rows", processed)]
    pieces = []
    for i, (k, v) in enumerate(parts):
        pieces.append(F.lit(("{" if i == 0 else ", ") + f'"{k}": '))
        pieces.append(_c(v).cast("string"))
    pieces.append(F.lit("}"))
    return F.concat(*pieces)


def decode_results(text: str | Column) -> Column:
    """JSON text -> STRUCT of four LONGs; NULL or '' -> NULL."""
    t = _c(text)
    return F.when(F.coalesce(F.length(t), F.lit(0)) > 0,
                  F.from_json(t, S.RESULTS_SCHEMA))


# --- durations ------------------------------------------------------------------

def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Whole seconds from start to end, truncated toward zero."""
    return F.timestamp_diff("SECOND", _c(start), _c(end))


def duration_text(seconds: str | Column) -> Column:
    """``h hours, m minutes, s seconds`` from a number of whole seconds (NULL stays NULL)."""
    s = _c(seconds)
    return F.when(s.isNotNull(), F.format_string("%d hours, %d minutes, %d seconds",
                                                 F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60))


# --- validation -------------------------------------------------------------------

def not_null_rule(col: str) -> tuple[Column, str]:
    return _c(col).isNull(), S.MSG_NOT_NULL.format(key=col)


def max_length_rule(col: str, n: int) -> tuple[Column, str]:
    return F.length(_c(col)) > n, S.MSG_TOO_LONG.format(key=col, n=n)


def min_length_rule(col: str, n: int, message: str) -> tuple[Column, str]:
    return F.length(_c(col)) < n, message


def pattern_rule(col: str, pattern: str, message: str) -> tuple[Column, str]:
    return ~_c(col).rlike(pattern), message


def account_rules(username: str = "username", email: str = "email") -> list[tuple[Column, str]]:
    """Rules of the account table: not null, String(50), username >= 3 and word
    characters only, e-mail pattern. Each rule is (violated?, message)."""
    return [
        not_null_rule(username),
        max_length_rule(username, 50),
        min_length_rule(username, 3, S.MSG_USERNAME_SHORT),
        pattern_rule(username, S.USERNAME_PATTERN, S.MSG_USERNAME_CHARS),
        not_null_rule(email),
        max_length_rule(email, 50),
        pattern_rule(email, S.EMAIL_PATTERN, S.MSG_EMAIL_INVALID),
    ]


def catalog_rules() -> list[tuple[Column, str]]:
    """Rules of the catalog table: key not null and String(50); status not null."""
    return [
        not_null_rule("brnumber"),
        max_length_rule("brnumber", 50),
        not_null_rule("download_status"),
    ]
