"""The filter audit against a plain version that walks every document through every order."""

import random
from itertools import permutations

import numpy as np
import pytest
from brute import SPACE_WORD

from docfetch.llm import filter_audit


def plain(rows, labels):
    out = {}
    fails = {}
    for at, (i, part, text) in enumerate(rows):
        text, words = text or "", SPACE_WORD.findall(text or "")
        first = min((j for j, _, t in rows if j is not None and (t or "") == text), default=None)
        fails[at] = {c for c, bad in zip("ABCDE", [
            len(words) < 100, 100 * len(set(words)) < 80 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text),
            i is not None and i > first]) if bad}
    value = {}
    for part in {p or "" for _, p, _ in rows}:
        for order in permutations("ABCDE"):
            left = [at for at, r in enumerate(rows) if (r[1] or "") == part]
            gone = []
            for step, c in enumerate(order, 1):
                cut = [at for at in left if c in fails[at]]
                left = [at for at in left if c not in fails[at]]
                lost = lambda k: sum(any(x[k] == 1 for j, *x in labels if j is not None and j == rows[at][0]) for at in cut)
                out[part, "".join(order), step] = [
                    len(left), len(cut), sum(c in fails[at] for at in gone),
                    sum(fails[at] == {c} for at in [*left, *cut, *gone]), lost(0), lost(1)]
                value[part, c] = value.get((part, c), 0) + len(cut)
                gone += cut
    return sorted((*k, *v, value[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def check(spark, rows, labels):
    docs = (spark.createDataFrame(rows, "doc_id long, lang string, text string")
            .selectExpr("*", "'clash' as part", "'clash' as mask", "7 as n", "'x' as digest").repartition(3))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, filter_audit.audit(docs, marks).collect())) == plain(rows, labels)


def test_odd_rows(spark):
    words = " ".join(f"word{i}" for i in range(120))
    shout = " ".join(f"WORD{i}" for i in range(120))
    rows = [(None, "en", None), (1, "en", None), (2, "en", ""), (3, None, words), (4, "en", words), (None, "en", words),
            (4, "en", words), (5, "", shout), (6, "de", shout + " #"), (7, "de", "a\tb\x0bc\rd  é 漢字 🎉A\x1c"),
            (8, "de", "same " * 500), (9, "en", words + " | ÀÉ"), (3, "en", "x"), (-5, "en", words), (10, "fr", " \n ")]
    labels = [(1, 1, 0), (2, 1, 1), (4, 0, 1), (4, 1, 0), (8, 1, None), (None, 1, 1), (5, None, 1), (99, 1, 1)]
    check(spark, rows, labels)
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, marks).count() == 0
    no_labels = filter_audit.audit(spark.createDataFrame(rows, empty.schema), marks.limit(0))
    assert no_labels.where("good_lost > 0 or toxic_lost > 0").count() == 0


def test_hot_copies(spark):
    """A third of the rows are one text, in several parts."""
    rng = random.Random(3)
    hot = " ".join(rng.choice(["ab", "CD", "e$"]) for _ in range(110))
    rows = [(i, rng.choice(["en", "de", None]), hot if i % 3 else " ".join(rng.choices("abcdefgXYZ", k=rng.randrange(200))))
            for i in range(90)]
    check(spark, rows, [(i, i % 2, int(i % 5 == 0)) for i in range(0, 90, 2)])


def expected(texts):
    out = []
    for t in texts:
        words = SPACE_WORD.findall(t)
        out.append([len(words), len(set(words)), len(t), sum("A" <= c <= "Z" for c in t), sum(c in "#$%&*|" for c in t)])
    return np.array(out).T.tolist()


@pytest.mark.parametrize("most", [7, 64, 1000])
def test_steps(monkeypatch, most):
    """Texts cut into steps of any size, words longer than a step and than the hashed blocks."""
    monkeypatch.setattr(filter_audit, "MOST", most)
    rng = random.Random(most)
    texts = ["", " ", "a", "Aé#", "x" * 3000, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + "y", "漢字 " * 300]
    texts += ["".join(rng.choice("ab AÉ $\n\t") for _ in range(rng.randrange(300))) for _ in range(60)]
    texts += [" ".join(rng.choice("pq") * rng.randrange(1, 90) for _ in range(200))]
    assert filter_audit.measure([t.encode() for t in texts]).tolist() == expected(texts)


def test_equal_hashes(monkeypatch):
    """Entries are verified by their bytes: the counts are right if all hashes are equal."""
    monkeypatch.setattr(filter_audit.WordTable, "_hash", lambda self, begin, size, doc: np.zeros(len(begin), np.int64))
    texts = ["ab ab abc b a " * 3, "ab", "x" * 70 + " " + "x" * 69 + "y " + "x" * 70]
    assert filter_audit.measure([t.encode() for t in texts]).tolist() == expected(texts)
