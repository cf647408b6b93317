"""The Merkle manifest against a tree built in one place."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docfetch.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    i, text, lang, source, n = row
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def grow(nodes, fanout):
    """All levels, from the leaves to the one that is left."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def walk(levels, i, fanout):
    for level in levels[:-1]:
        run = i // fanout * fanout
        yield level[run:i], level[i + 1:run + fanout]
        i //= fanout


def plain(rows, fanout):
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append(r)
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        parts[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = grow([leaf(r) for r in parts[name]], fanout)
    top = grow([trees[n][-1][0] for n in names], fanout)
    out = []
    for at, name in enumerate(names):
        for i, r in enumerate(parts[name]):
            path = [*walk(trees[name], i, fanout), *walk(top, at, fanout)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r, changed)
            for left, right in path:
                node = h(*left, node, *right)
            out.append((r[0], leaf(r), trees[name][-1][0], top[-1][0],
                        h(*(x for left, right in path for x in left + right)), node, node == top[-1][0]))
    return out


def rows_of(n, seed, langs):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i * 1000, -i]), rng.choice([f"Text {i}", "É A 漢", "", None, "lower"]), rng.choice(langs),
             rng.choice([None, "s:1", ""]), rng.choice([None, i])) for i in range(n)]
    return rows + rows[:3] + [(None, "Aa", langs[0], None, None), (None, None, None, None, None)]


def same(got, rows, fanout):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows, fanout), key=key)


@pytest.mark.parametrize("fanout,levels,n", [(8, 3, 700), (2, 1, 90), (3, 1, 200), (3, 2, 100), (8, 1, 130)])
def test_manifest(spark, fanout, levels, n):
    """Full and ragged trees: several rounds, last runs of one, parts of one leaf."""
    rows = rows_of(n, fanout * n, ["en"] * 20 + ["de", "", None, "fr", "x\x00", "z"] + [f"l{i}" for i in range(5)])
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'c' as part", "1 as block", "2 as id", "'p' as path")
    tamper, tampered = merkle.lower_cased()
    out = merkle.manifest(docs.repartition(5), fanout, levels, tamper=tamper, tampered=tampered).drop("part")
    got = out.collect()
    same(got, rows, fanout)
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 10, 17, 26, 27, 28])
def test_small_sizes(spark, n):
    rows = [(i, "T", "en", "s", 1) for i in range(n)]
    tamper, tampered = merkle.lower_cased()
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA), 3, 1, tamper=tamper, tampered=tampered).drop("part")
    same(out.collect(), rows, 3)


def test_untampered_and_empty(spark):
    docs = spark.createDataFrame(rows_of(50, 1, ["a", "b"]), SCHEMA)
    assert merkle.manifest(docs).where(~F.col("verified")).count() == 0
    assert merkle.manifest(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(docs, fanout=1)
