"""Quality rules with risk-controlled thresholds, on DataFrame functions alone.

Every rule compares a text statistic with a cutoff. Which cutoffs are used is decided
on labelled documents: for each stratum, rule and cutoff of a fixed grid, the good
documents it would reject are counted, and the exact binomial tail gives the p-value of
"it rejects more than its share of good documents". Holm's correction over all tests
keeps the chance of one wrong cutoff at ``delta``. The certified cutoffs are used; a
stratum with too few labels has none and keeps what the base rules keep.

The allowed false rejection ``alpha`` of a stratum is split evenly over the rules, so a
document that any certified rule rejects counts against it once.

Defined cases: a null or empty text has no words and fails the base rule; a null stratum
is a stratum; a document labelled several times is good if all its labels say so; labels
without a document, or null ones, play no part; repeated rows each get a row; with no
labels nothing is certified; columns other than the named ones are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfetch.llm.chunks import stored
from docfetch.llm.native import SPACE_WORD, covered, find_all, indices, let

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
REPEAT = 5
#: rule -> (left side, right side times the cutoff, cutoffs): rejects where left > right * cutoff
RULES = {
    "few_words": ("-n_words", "-1", [12, 15, 20, 30, 40]),
    "symbols": ("1000 * n_symbols", "word_chars", [10, 20, 50, 100, 200]),
    "dup_lines": ("100 * n_dup_lines", "n_lines", [10, 20, 30, 50]),
    "repeats": ("100 * n_repeat_words", "n_words", [2, 5, 10, 15]),
    "long_words": ("10 * word_chars", "n_words", [80, 100, 120, 150]),
    "short_words": ("-10 * word_chars", "-n_words", [20, 30]),
}
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def features(text: Column) -> dict[str, Column]:
    """The text statistics the rules use, as expressions over the ``words`` and ``lines``
    columns that ``with_features`` makes."""
    n = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return {
        "n_words": n(F.size("words")),
        "word_chars": n(F.length(F.translate(text, SPACES, ""))),
        "n_symbols": n(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))),
        "n_lines": n(F.size("lines")),
        "n_dup_lines": n(F.size("lines") - F.size(F.array_distinct("lines"))),
        "n_repeat_words": n(_repeat_words(F.col("words"))),
    }


def _repeat_words(words: Column) -> Column:
    """Words inside a window of five that is found twice or more in the text."""
    def grams(h: Column) -> Column:
        return F.transform(indices(F.size(h) - (REPEAT - 1)), lambda i: F.xxhash64(*(h[i + j] for j in range(REPEAT))))

    def spans(g: Column) -> Column:
        placed = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("key"), i.alias("at"))))
        near = lambda s, e, j: F.coalesce(F.get(s, j)["key"] == e["key"], F.lit(False))
        twice = let(placed, lambda s: F.filter(s, lambda e, j: near(s, e, j - 1) | near(s, e, j + 1)))
        return F.transform(twice, lambda e: F.struct(e["at"].alias("start"), (e["at"] + REPEAT).alias("end")))

    count = lambda g: (F.when(F.size(F.array_distinct(g)) < F.size(g), covered(spans(g)))
                       .otherwise(F.lit(0)))
    return let(let(F.transform(words, lambda w: F.xxhash64(w)), grams), count)


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  stratum_col: str = "lang") -> DataFrame:
    text = F.col("text")
    split = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                         F.col(stratum_col).cast("string").alias("stratum"))
             .withColumn("words", find_all(text, SPACE_WORD))
             .withColumn("lines", F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1),
                                           lambda x: x.rlike(SPACE_WORD))))
    return split.select("doc_id", "stratum", *(c.alias(name) for name, c in features(text).items()))


def certify(feats: DataFrame, labels: DataFrame, alpha: float, delta: float, id_col: str = "doc_id",
            good_col: str = "quality") -> DataFrame:
    """(stratum, rule, cutoff, n, k, p_value): the certified tests."""
    good = (labels.where(F.col(good_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
            .agg(F.min(good_col).alias("good")).where("good = 1"))
    share = alpha / len(RULES)
    tests = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"),
                               F.expr(f"{left} > {right} * {c}").alias("rejects"))
                      for rule, (left, right, cutoffs) in RULES.items() for c in cutoffs))
    counts = (feats.where(f"not ({BASE_FAILED})").join(good, "doc_id", "left_semi")
              .select("stratum", F.explode(tests).alias("t")).groupBy("stratum", "t.rule", "t.cutoff")
              .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("t.rejects").cast("long")).alias("k")))
    tested = counts.withColumn("p_value", binomial_tail(F.col("n"), F.col("k"), share))
    # Holm: of m p-values the i-th least goes against delta / (m - i + 1), up to the first
    # that fails. Ties share a rank, so p-values are ranked by how many are less.
    rows = tested.groupBy("p_value").count().orderBy("p_value").collect()  # strata times cutoffs at most
    left, failed = sum(r["count"] for r in rows), None
    for r in rows:
        if r["p_value"] * left > delta:
            failed = r["p_value"]
            break
        left -= r["count"]
    return tested if failed is None else tested.where(F.col("p_value") < F.lit(failed))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term in logarithms; 1 from the mean up (the
    cutoff cannot be certified there)."""
    step = lambda acc, i: let(
        acc["term"] + F.log(n - i + 1) - F.log(i) + F.lit(math.log(p) - math.log1p(-p)),
        lambda term: F.struct(term.alias("term"), (F.greatest(acc["total"], term) + F.log1p(
            F.exp(-F.abs(acc["total"] - term)))).alias("total")))
    first = n * F.lit(math.log1p(-p))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    tail = F.exp(F.aggregate(terms, F.struct(first.alias("term"), first.alias("total")), step, lambda acc: acc["total"]))
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(tail)


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05,
                stratum_col: str = "lang") -> DataFrame:
    """Per document row: the statistics, base_failed, ``failed_rules`` and kept."""
    feats = stored(with_features(docs, stratum_col=stratum_col), "rule_features")
    certified = stored(certify(feats, labels, alpha, delta), "certified")
    # cutoffs are nested: the strictest certified one decides
    strictest = {rule: F.max if right.startswith("-") else F.min for rule, (_, right, _) in RULES.items()}
    cutoffs = (certified.groupBy(F.col("stratum").alias("of_stratum"))
               .agg(*(best(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"at_{rule}")
                      for rule, best in strictest.items())))
    failed = F.array_compact(F.array(*(F.when(F.expr(f"{left} > {right} * at_{rule}"), F.lit(rule))
                                       for rule, (left, right, _) in RULES.items())))
    base = F.expr(BASE_FAILED)
    return (feats.join(cutoffs, F.col("stratum").eqNullSafe(F.col("of_stratum")), "left")
            .select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base.alias("base_failed"), failed.alias("failed_rules"),
                    (~base & (F.size(failed) == 0)).alias("kept")))
