"""Filter interaction audit: what every order of five text filters keeps, removes and repeats.

The filters: A too few words, B too few distinct words, C too many capitals, D a forbidden
symbol, E the text of a document with a smaller id (whatever the other filters say of it).

One pass over the bytes judges A to D: a transducer with two states (between words, in a
word) reads a table by (state, byte) and emits marks for word begins, word ends, capitals,
code points and symbols; the word spans go into an open-addressing hash table, where an
entry counts as equal only when its bytes are. E needs no rows side by side: documents are
counted by the digest of their text, so a text with very many copies is a few rows.

What a filter removes under an order depends only on the set of filters a document fails,
so the 120 orders are played over at most 32 counts per part, not over documents.

Defined cases: a null text is an empty one, also when texts are compared; a null language
is the part ''; a null doc_id has no smaller id and is smaller than none; rows that share a
doc_id and a text are documents of their own, the least id's rows all pass E; a document is
good or toxic if any of its label rows says so; a document without labels is neither; an
empty table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docfetch.llm.chunks import mix, pieces, small_batches

LETTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
MOST = 1 << 20          # bytes that one step of the pass looks at
BEGIN, END, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8, 16
JUDGED = ("doc_id long, part string, digest binary, n_words long, n_distinct long, n_points long, n_capitals long, "
          "n_symbols long")


def transducer(symbols: bytes = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """The next state by byte, and the marks by (state, byte). State 1 is within a word.
    Whether a byte belongs to a word does not depend on the state, so all bytes of a text
    can step at once."""
    byte = np.arange(256)
    inside = ~np.isin(byte, [0x20, 9, 10, 11, 12, 13])
    marks = (np.where((byte & 0xC0) != 0x80, POINT, 0) | np.where((byte >= 65) & (byte <= 90), CAPITAL, 0)
             | np.where(np.isin(byte, list(symbols)), SYMBOL, 0))
    emit = np.stack([marks | np.where(inside, BEGIN, 0), marks | np.where(inside, 0, END)]).astype(np.uint8)
    return inside.astype(np.uint8), emit


class WordTable:
    """Distinct (document, word) pairs: spans of ``text`` in open-addressing slots."""

    def __init__(self, text: np.ndarray, size_log: int = 12):
        self.text = text
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        self.eights = np.ndarray(len(text) + 1, "<u8", padded, strides=(1,))     # the 8 bytes from each place
        self._slots(size_log)

    def _slots(self, size_log: int) -> None:
        self.slots = np.full(1 << size_log, -1, np.int64)
        self.mask = np.int64((1 << size_log) - 1)
        self.entries = np.empty((4, 1 << size_log - 1), np.int64)                # hash, begin, size, document
        self.used = 0

    def _block(self, begin: np.ndarray, size: np.ndarray, at: int) -> np.ndarray:
        """Bytes at .. at + 7 of each word, zero behind its end."""
        left = np.minimum(size - at, 8).astype(np.uint64)
        return self.eights[begin + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))

    def _hash(self, begin: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
        out = mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64))
        todo, at = np.arange(len(begin)), 0
        while len(todo) and at < 64:
            out[todo] = mix(out[todo] ^ self._block(begin[todo], size[todo], at))
            at += 8
            todo = todo[size[todo] > at]
        for i in todo.tolist():                     # the few words of more than 64 bytes
            word = self.text[begin[i]:begin[i] + size[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") ^ int(doc[i])
        return out.view(np.int64)

    def _equal(self, begin: np.ndarray, size: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Are the bytes of the words those of the entries (of the same sizes)?"""
        other = self.entries[1, entry]
        equal, todo, at = np.ones(len(begin), bool), np.arange(len(begin)), 0
        while len(todo) and at < 64:
            equal[todo] &= (self._block(begin[todo], size[todo], at) == self._block(other[todo], size[todo], at))
            at += 8
            todo = todo[equal[todo] & (size[todo] > at)]
        for i in todo.tolist():
            equal[i] = np.array_equal(self.text[begin[i]:begin[i] + size[i]], self.text[other[i]:other[i] + size[i]])
        return equal

    def insert(self, begin: np.ndarray, end: np.ndarray, doc: np.ndarray) -> None:
        size = end - begin
        need = 2 * (self.used + len(begin))          # at most half of the slots are taken
        if need > len(self.slots):
            known = self.entries[:, :self.used]
            self._slots(int(need).bit_length())
            self._place(*known)
        self._place(self._hash(begin, size, doc), begin, size, doc)

    def _place(self, key: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray) -> None:
        todo, slot = np.arange(len(key)), key & self.mask
        turn = np.empty(len(self.slots), np.int64)
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            if len(free):                           # one word takes each free slot
                turn[slot[free]] = free
                taken = free[turn[slot[free]] == free]
                places = slice(self.used, self.used + len(taken))
                self.slots[slot[taken]] = np.arange(places.start, places.stop)
                for row, values in zip(self.entries, (key, begin, size, doc)):
                    row[places] = values[taken]
                self.used = places.stop
            entry = self.slots[slot[todo]]
            same = ((self.entries[0, entry] == key[todo]) & (self.entries[2, entry] == size[todo])
                    & (self.entries[3, entry] == doc[todo]))
            at = np.flatnonzero(same)
            same[at] = self._equal(begin[todo[at]], size[todo[at]], entry[at])
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & self.mask

    def distinct(self, n: int) -> np.ndarray:
        return np.bincount(self.entries[3, :self.used], minlength=n)


_STEP, _EMIT = transducer()


def measure(texts: list[bytes]) -> np.ndarray:
    """Words, distinct words, code points, capitals and symbols of each text (5 x n)."""
    out = np.zeros((5, len(texts)), np.int64)
    for a, b in pieces(np.array([len(t) for t in texts], np.int64), MOST):
        joined = b" ".join(texts[a:b]) + b" "       # a space ends each text's last word
        text = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts[a:b]])
        table, counts = WordTable(text), out[:, a:b]
        counts[2] = -1                               # the added space is no code point of the text
        at = 0
        while at < len(text):                        # a long text goes in steps cut behind a space
            to = min(at + MOST, len(text))
            if to < len(text):
                cut = np.flatnonzero(_STEP[text[at:to]] == 0)
                to = at + int(cut[-1]) + 1 if len(cut) else _next_space(text, to)
            _step(text, at, to, ends, table, counts)
            at = to
        counts[1] = table.distinct(b - a)
    return out


def _next_space(text: np.ndarray, at: int) -> int:
    while True:
        found = np.flatnonzero(_STEP[text[at:at + MOST]] == 0)
        if len(found):
            return at + int(found[0]) + 1
        at += MOST


def _step(text: np.ndarray, at: int, to: int, ends: np.ndarray, table: WordTable, counts: np.ndarray) -> None:
    part = text[at:to]
    state = np.zeros(len(part), np.intp)
    state[1:] = _STEP[part[:-1]]
    emitted = _EMIT.reshape(-1)[(state << 8) + part]
    first, last = np.searchsorted(ends, [at, to - 1], side="right")
    cuts = np.maximum(np.concatenate([[0], ends])[first:last + 1] - at, 0)
    for row, mark in ((2, POINT), (3, CAPITAL), (4, SYMBOL)):
        counts[row, first:last + 1] += np.add.reduceat((emitted & mark) != 0, cuts, dtype=np.int64)
    begin = np.flatnonzero(emitted & BEGIN) + at
    end = np.flatnonzero(emitted & END) + at
    doc = np.searchsorted(ends, begin, side="right")
    counts[0] += np.bincount(doc, minlength=counts.shape[1])
    table.insert(begin, end, doc)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per document row: its counts and the digest of its text."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def counts(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            digests = [hashlib.sha256(t).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["part"], pa.array(digests, pa.binary()),
                 *(pa.array(row, pa.int64()) for row in measure(texts))],
                names=[c.split()[0] for c in JUDGED.split(", ")])

    return base.mapInArrow(counts, JUDGED)


def audit(docs: DataFrame, labels: DataFrame, min_words: int = 100, min_distinct: int = 80, max_capitals: int = 10,
          id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per part, filter order and step (1-5): documents kept after the step, removed by it,
    ``redundant`` (failing its filter but removed before), ``unique_fails`` (failing its
    filter alone), the good and toxic ones it removes, and ``shapley``, what its filter
    removes summed over all orders. Percentages as whole numbers."""
    fails = [F.col("n_words") < min_words, 100 * F.col("n_distinct") < min_distinct * F.col("n_words"),
             100 * F.col("n_capitals") > max_capitals * F.col("n_points"), F.col("n_symbols") > 0]
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0))
    rows = judge(docs, id_col, text_col, part_col).select("doc_id", "part", "digest", mask.alias("mask"))

    # a null id matches no label: a key of its own keeps such rows apart
    known = labels.select(F.col("doc_id").cast("long").alias("labelled"),
                          F.lit(True).alias("has_label"), "quality", "toxic").where("labelled is not null")
    known = known.groupBy("labelled", "has_label").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    keyed = rows.withColumn("key", F.coalesce("doc_id", F.monotonically_increasing_id()))
    marked = (keyed.join(known, (F.col("key") == F.col("labelled")) & (F.col("doc_id").isNotNull() == F.col("has_label")),
                         "left")
              .select("doc_id", "part", "digest", "mask", F.coalesce("good", F.lit(False)).alias("good"),
                      F.coalesce("toxic", F.lit(False)).alias("toxic")))
    return play(_cells(marked))


def _cells(marked: DataFrame) -> DataFrame:
    """Documents, good and toxic ones by part and set of failed filters (a bit each)."""
    kind = ["digest", "part", "mask", "good", "toxic"]
    by_id = marked.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    groups = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), least.alias("least"),
                                      F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    # one row per kind of document a text has (the copies are only counted), so the window is short
    first_id = F.min("least.doc_id").over(Window.partitionBy("digest"))
    split = groups.withColumn("first_id", first_id).withColumn(
        "passing", F.col("no_id") + F.when(F.col("least.doc_id") == F.col("first_id"), F.col("least.n")).otherwise(0))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")),
                   F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    of = lambda c: F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0)).alias(f"n_{c}")
    return (split.select("part", "good", "toxic", F.explode(both).alias("x")).where("x.n > 0")
            .groupBy("part", F.col("x.mask").alias("mask"))
            .agg(F.sum("x.n").alias("n"), of("good"), of("toxic")))


def play(cells: DataFrame) -> DataFrame:
    """Every order of the filters over the counts by failed set."""
    bit = lambda letter: F.element_at(F.array(*(F.lit(1 << i) for i in range(5))), F.ascii(letter) - 64)
    orders = F.array(*(F.lit("".join(p)) for p in permutations(LETTERS)))
    steps = (cells.select("*", F.explode(orders).alias("filter_order"))
             .select("*", F.split("filter_order", "").alias("letters"))
             .select("*", F.posexplode("letters").alias("before", "letter")))
    steps = steps.select("*", bit(F.col("letter")).alias("own"), F.aggregate(
        F.slice("letters", F.lit(1), F.col("before")), F.lit(0), lambda acc, x: acc + bit(x)).alias("earlier"))
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("earlier")) != 0
    total = lambda c, n, name: F.sum(F.when(c, F.col(n)).otherwise(0)).cast("long").alias(name)
    counted = steps.groupBy("part", "filter_order", (F.col("before") + 1).cast("int").alias("step"), "letter").agg(
        total(~fails & ~gone, "n", "kept"), total(fails & ~gone, "n", "removed"), total(fails & gone, "n", "redundant"),
        total(F.col("mask") == F.col("own"), "n", "unique_fails"), total(fails & ~gone, "n_good", "good_lost"),
        total(fails & ~gone, "n_toxic", "toxic_lost"))
    value = counted.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return counted.join(value, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        "shapley")
