"""Keys of words and windows: structured texts that polynomial hashes confuse, texts of
several pieces, hot lines."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from docfetch.llm import decontaminate, jaccard_join, keys, substring, suffix_buckets


def morse(n, a="a", b="b"):
    word = a
    while len(word) < n:
        word += "".join(b if c == a else a for c in word)
    return word[:n]


def same(got, expected):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_window_keys():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    for n in range(1, 24):
        got, checks = keys.window_keys(words, n), keys.window_checks(words, n)
        seen = {}
        for i in range(len(words) - n + 1):
            window = tuple(words[i:i + n].tolist())
            assert seen.setdefault(window, (got[i], checks[i])) == (got[i], checks[i])
        assert len({k for k, _ in seen.values()}) == len({c for _, c in seen.values()}) == len(seen)


def test_byte_keys():
    text = np.frombuffer(b"ab\0ab\0\0abababab" + b"x" * 200, np.uint8)
    spans = [(a, b) for a in range(0, len(text), 3) for b in range(a + 1, len(text) + 1)]
    begin, end = (np.array(x) for x in zip(*spans))
    of_bytes = {}
    for (a, b), k in zip(spans, keys.byte_keys(text, begin, end).tolist()):
        assert of_bytes.setdefault(text[a:b].tobytes(), k) == k
    assert len(set(of_bytes.values())) == len(of_bytes)


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_thue_morse(spark, n):
    """A word, its complement (equal under any polynomial modulo 2**64), and sequences of two words."""
    one, two = morse(n), morse(n, "b", "a")
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, f"{one} x y z"), (4, f"{two} x y z"),
            (5, " ".join(morse(n))), (6, " ".join(morse(n, "b", "a"))), (7, one * 2), (8, two * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = substring.dedup_substrings(docs)
    same(out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect(), brute.substrings(rows))
    got = jaccard_join.groups(docs).select("doc_id", "n_shingles", "component_id").collect()
    same(got, brute.jaccard(rows, 3, 90))
    out = suffix_buckets.dedup_suffixes(docs)
    same(out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect(), brute.suffixes(rows))


def test_long_texts_and_a_hot_line(spark):
    """Texts of several pieces of a chunk each, and a line that all texts hold."""
    rng = random.Random(4)
    line = " ".join(f"license{i}" for i in range(25))
    long = [" ".join(str(rng.randrange(10 ** 6)) for _ in range(60_000)) for _ in range(2)]
    rows = [(0, long[0] + " " + line), (1, long[1]), (2, long[0][:300_000] + " " + line + long[1][200_000:]), (3, long[1] + " x")]
    rows += [(i, " ".join(str(rng.randrange(10 ** 6)) for _ in range(40)) + " " + line + f" {i}") for i in range(4, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    out = substring.dedup_substrings(docs)
    same(out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect(), brute.substrings(rows))
    out = suffix_buckets.dedup_suffixes(docs)
    same(out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect(), brute.suffixes(rows))


def test_repeated_words_through_decontamination(spark):
    """Texts of one or two words that align with an item in thousands of ways."""
    rows = [(1, "a " * 16_000), (2, "b " * 20_000), (3, "a b " * 8_000), (4, "x y")]
    items = [(1, "a " * 12), (2, "b " * 1000), (3, "a b a b"), (4, "a b " * 7)]
    out = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"),
                                      spark.createDataFrame(items, "item_id long, text string"))
    same(out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long"), F.sha2(F.array_join("item_ids", ","), 256),
                    F.col("n_hit") > 0).collect(), brute.decontamination(rows, items))
