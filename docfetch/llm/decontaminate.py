"""Benchmark decontamination by winnowing, on DataFrame functions alone.

Of the hashes of all k-word grams, the least of every w consecutive ones is kept as a
fingerprint. Two texts that share k + w - 1 words share that window's least hash, so
joining document and benchmark fingerprints finds every shared span of that length.
Documents with a common fingerprint are extended: their windows are joined with the items'
distinct windows by hash, and a hit counts only if its words are the window's. So a document
of repeated words costs a row per word, however many ways it could be aligned with an item.

An item shorter than a window is one window of its own; its one gram is its fingerprint,
looked for among the document grams of that length (only for lengths that occur).

Defined cases: null and empty texts have no words (an item without words plays no part);
items with one text count once each by id; an item without id is hit but not listed;
repeated document rows each get a row; a null doc_id is a document like others; an empty
benchmark hits nothing; columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfetch.llm.chunks import stored
from docfetch.llm.native import covered, find_all, indices, join_documents, let, lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return find_all(lower_ascii(text), WORD)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5, id_col: str = "doc_id",
                  text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                  keep_key: bool = False) -> DataFrame:
    """Per document row: n_words, n_hit, item_ids (sorted) and ``spans``, the hit word
    windows as (start, end) structs; ``keep_key`` adds text_key, xxhash64 of the text."""
    if not 1 <= gram <= window:
        raise ValueError("a gram has 1 to window words")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bench = stored(items.select(F.col(item_id_col).cast("string").alias("item_id"),
                                words(F.col(item_text_col).cast("string")).alias("item_words"))
                   .where(F.size("item_words") > 0)
                   .groupBy("item_words").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
                   .withColumn("item", F.monotonically_increasing_id()), "items")
    lengths = sorted(r[0] for r in bench.where(F.size("item_words") < window)     # at most window - 1 values
                     .select(F.size("item_words")).distinct().collect())

    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))

    def grams(h: Column, n: int, mark: int = 0) -> Column:
        tail = [F.lit(-mark)] if mark else []
        return F.transform(indices(F.size(h) - (n - 1)), lambda i: F.xxhash64(*(h[i + j] for j in range(n)), *tail))

    def least(g: Column) -> Column:
        n = window - gram + 1
        if n == 1:
            return g
        return F.transform(indices(F.size(g) - (n - 1)), lambda i: F.least(*(g[i + j] for j in range(n))))

    def prints(h: Column) -> Column:
        kept = [let(grams(h, gram), least)] + [grams(h, m, m) for m in lengths]
        return F.array_distinct(F.concat(*kept) if len(kept) > 1 else kept[0])

    # item fingerprints
    item_prints = stored(bench.select(F.explode(prints(hashes(F.col("item_words")))).alias("print")).distinct(),
                         "item_prints")

    # which documents share a fingerprint; one row per document row
    known = item_prints.withColumn("known", F.lit(True))
    flags = stored(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"),
                    hashes(words(F.col("text"))).alias("h"))
        .select("row", "doc_id", "text_key", F.size("h").alias("n_words"),
                F.explode_outer(prints(F.col("h"))).alias("print"))
        .join(known, "print", "left")
        .groupBy("row", "doc_id", "text_key", "n_words").agg(F.max("known").alias("known")), "print_flags")

    wanted = flags.where("known").select("doc_id", "text_key").distinct()
    keyed = docs.where("text is not null").withColumn("text_key", F.xxhash64("text"))
    found = stored(join_documents(keyed, wanted, "left_semi").dropDuplicates(["doc_id", "text_key"])
                   .select("doc_id", "text_key", words(F.col("text")).alias("words")), "fingerprinted")

    # the items' distinct windows; the hash is of word hashes and the length, as in documents
    size = F.least(F.lit(window), F.size("item_words"))
    starts = lambda w, n: indices(F.size(w) - n + 1)
    item_windows = F.transform(starts(F.col("item_words"), size), lambda i: F.slice("item_words", i + 1, size))
    windows = stored(bench.select("item_ids", F.explode(item_windows).alias("words"))
                     .groupBy("words").agg(F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))
                     .withColumn("print", _window_print(hashes(F.col("words")), [window, *lengths]))
                     .withColumn("window", F.monotonically_increasing_id()), "item_windows")

    # hits: (start, size) of the document's windows whose hash is an item window's
    prints_at = lambda h: F.concat(*(F.transform(grams(h, n, n), lambda x, i: F.struct(
        x.alias("print"), i.alias("start"), F.lit(n).alias("n"))) for n in [window, *lengths]))
    probes = (found.select("doc_id", "text_key", F.explode(let(hashes(F.col("words")), prints_at)).alias("p"))
              .select("doc_id", "text_key", "p.*"))
    met = (probes.join(windows.select("print", "window", F.array_join("words", " ").alias("text")), "print")
           .groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "n", "window", "text")).alias("met")))
    equal = lambda x: F.array_join(F.slice("words", x["start"] + 1, x["n"]), " ") == x["text"]
    hits = stored(join_documents(found, met, "inner")
                  .select("doc_id", "text_key", F.filter("met", equal).alias("met")).where(F.size("met") > 0)
                  .select("doc_id", "text_key", F.array_distinct(F.col("met.window")).alias("windows"),
                          F.array_sort(F.array_distinct(F.transform("met", lambda x: F.struct(
                              x["start"].alias("start"), (x["start"] + x["n"]).alias("end"))))).alias("spans")), "hits")
    items_of = (hits.select("doc_id", "text_key", F.explode("windows").alias("window"))
                .join(windows.select("window", F.explode("item_ids").alias("item")), "window")
                .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("item_ids")))
    hits = join_documents(hits.select("doc_id", "text_key", "spans"), items_of, "left")
    no_spans = F.array().cast("array<struct<start:int,end:int>>")
    return (join_documents(flags, hits, "left")
            .select("doc_id", *["text_key"] * keep_key, F.col("n_words").cast("long").alias("n_words"),
                    F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                    F.coalesce("spans", no_spans).alias("spans")))


def _window_print(h: Column, sizes: list[int]) -> Column:
    """The hash that documents give a window of these words (whose number is one of the sizes)."""
    out = F.lit(None).cast("long")
    for n in sizes:
        out = F.when(F.size(h) == n, F.xxhash64(*(h[i] for i in range(n)), F.lit(-n))).otherwise(out)
    return out
