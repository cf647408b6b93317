"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (+1), bad (-1) or nothing (0) on every document: one
for each kind of defect, which says nothing of documents without it, and one for plain prose.
Expectation-maximisation over the counts of vote patterns of all documents estimates how
each labeller votes on good and on bad ones; where a hand label exists the class is
known. The posterior labels of a bounded sample (``sample`` documents, labelled ones
first, in the order of a hash) train a linear scorer over hashed words and the votes,
and the scorer judges every document.

Only two things reach the driver: the pattern counts (3**8 patterns by label at most) and
the sample.

Defined cases: a null or empty text has no words; its labellers abstain and the scorer's
bias decides; labels that are null or without a document play no part, a document with
several labels is bad if one says so; repeated rows are judged each; an empty table gives
an empty result; columns of the input with the names of the result's are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfetch.llm.chunks import get_ints, give_back, giving_back, pieces, put_ints, small_batches, span_hash
from docfetch.llm.words import NOT_ALNUM, text_bytes, word_keys, word_spans

SLOTS_LOG = 18
STEMS = (4, 5, 6)    # bytes of the word beginnings that are features beside the words
# A gazetteer of insults.
INSULTS = ["clown", "disgusting", "dumb", "fool", "garbage", "idiot", "idiotic", "imbecile", "loser", "moron",
           "pathetic", "scum", "stupid", "trash", "vermin", "worthless"]
BLOCK = 1 << 16      # slots of the sample that a training step works on at a time
LABELLERS = ["symbols", "tables", "shouting", "exclaims", "stutters", "repeats", "insults", "prose"]
NO_LABEL = -1


def _class_counts(text: np.ndarray, ends: np.ndarray, chars: bytes) -> np.ndarray:
    member = np.zeros(256, bool)
    member[list(chars)] = True
    total = np.concatenate([[0], np.cumsum(member[text])])
    return np.diff(total[np.concatenate([[0], ends])])


def _per_doc(flags: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(total[np.concatenate([[0], np.cumsum(counts)])])


def _vote(value: np.ndarray, good_below: float, bad_from: float) -> np.ndarray:
    return np.where(value >= bad_from, -1, np.where(value < good_below, 1, 0))


def signals(texts: pa.Array):
    """Runs of documents: votes (documents x labellers), and the hashed words as
    (document, slot, weight): the words and word beginnings it has, of length one a document."""
    insults = np.sort(np.concatenate([k for _, k, _ in word_keys(pa.array(INSULTS), separator=NOT_ALNUM)]))
    for (_, text, ends), (_, sums, begin, end, counts) in zip(text_bytes(texts), word_spans(texts, separator=NOT_ALNUM)):
        keys = span_hash(sums, begin, end)
        n, doc = np.maximum(counts, 1), np.repeat(np.arange(len(counts)), counts)
        upper = _class_counts(text, ends, bytes(range(65, 91)))
        letters = upper + _class_counts(text, ends, bytes(range(97, 123)))
        same = np.zeros(len(keys), bool)
        same[1:] = (keys[1:] == keys[:-1]) & (doc[1:] == doc[:-1])
        grams = keys[:-2] * np.uint64(3) + keys[1:-1] * np.uint64(5) + keys[2:] * np.uint64(7)
        whole = doc[2:] == doc[:-2]
        order = np.lexsort((grams[whole], doc[:-2][whole]))
        g, d = grams[whole][order], doc[:-2][whole][order]
        again = np.concatenate([[False], (g[1:] == g[:-1]) & (d[1:] == d[:-1])])[:len(g)]
        repeats = np.bincount(d, weights=again, minlength=len(counts)) / np.maximum(counts - 2, 1)
        found = _per_doc(insults[np.minimum(np.searchsorted(insults, keys), len(insults) - 1)] == keys, counts)
        votes = np.stack([
            _vote(_class_counts(text, ends, b"#*$%&<>~^") / n, 0, 0.3),
            _vote(_class_counts(text, ends, b"|") / n, 0, 0.2),
            _vote(np.where(letters > 20, upper / np.maximum(letters, 1), 0.1), 0, 0.5),
            _vote(_class_counts(text, ends, b"!") / n, 0, 0.5),
            _vote(_per_doc(same, counts) / n, 0, 0.2),
            _vote(repeats, 0, 0.4),
            np.where(found >= 0.01 * n, -(found > 0).astype(int), 0),
            # the one labeller that speaks for a document: plain and civil prose
            np.where(found > 0, 0, _vote((_class_counts(text, ends, b"#*$%&<>~^|!=_{}[]") + upper / 4) / n + repeats,
                                         0.3, np.inf)),
        ], axis=1)
        votes[counts == 0] = 0
        stems = [span_hash(sums, begin[long], begin[long] + p) + np.uint64(p)
                 for p in STEMS for long in [end - begin >= p]]
        owner = np.concatenate([doc, *(doc[end - begin >= p] for p in STEMS)])
        slots = (np.concatenate([keys, *stems]) >> np.uint64(64 - SLOTS_LOG)).astype(np.int64)
        cells = np.unique((owner << SLOTS_LOG) | slots)
        row = cells >> SLOTS_LOG
        weight = 1 / np.sqrt(np.bincount(row, minlength=len(counts)))[row]
        yield votes, row, cells & ((1 << SLOTS_LOG) - 1), weight


def _patterns(votes: np.ndarray) -> np.ndarray:
    return (votes + 1) @ (3 ** np.arange(len(LABELLERS)))


def _unpack(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def label_model(pattern: np.ndarray, label: np.ndarray, count: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior probability of good for each (pattern, label) row."""
    table = _unpack(pattern)
    known = label != NO_LABEL
    # begin with every defect that a labeller reports taken for one: junk of one kind looks
    # good to the labellers of all other kinds, so a majority would hide it
    post = np.where(known, label, np.where((table == 0).any(axis=1), 0.1, 0.9))
    for _ in range(rounds):
        prior = (count @ post + 1) / (count.sum() + 2)
        log_odds = np.full(len(count), np.log(prior / (1 - prior)))
        for j in range(len(LABELLERS)):
            good = np.bincount(table[:, j], weights=count * post, minlength=3) + 1
            bad = np.bincount(table[:, j], weights=count * (1 - post), minlength=3) + 1
            log_odds += np.log((good / good.sum()) / (bad / bad.sum()))[table[:, j]]
        post = np.where(known, label, 1 / (1 + np.exp(-np.clip(log_odds, -30, 30))))
    return post


def train(votes: np.ndarray, slot: np.ndarray, sizes: np.ndarray, target: np.ndarray,
          steps: int = 150, ridge: float = 1e-4, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression by full gradient steps (Adam); (dense weights, slot weights).
    ``slot`` has the slots of one document behind those of another, ``sizes`` their numbers.
    A slot enters by its log ratio between good and bad documents, so that rare tell-tale
    words need no more steps than frequent ones. A step goes through the documents in
    blocks: beside the slots themselves it holds nothing that is as long as they are."""
    dense, size = _dense(votes), 1 << SLOTS_LOG
    length = (1 / np.sqrt(np.maximum(sizes, 1))).astype(np.float32).astype(float)
    ends = np.cumsum(sizes)
    runs = list(pieces(sizes, BLOCK))

    def blocks():
        for a, b in runs:
            yield slice(a, b), slot[ends[a] - sizes[a]:ends[b - 1]].astype(np.int64), sizes[a:b]

    good, bad = np.zeros(size), np.zeros(size)
    for docs, slots, n in blocks():
        np.add.at(good, slots, np.repeat(target[docs], n))
        np.add.at(bad, slots, np.repeat(1 - target[docs], n))
    ratio = np.log(((good + 1) / (target.sum() + 2)) / ((bad + 1) / ((1 - target).sum() + 2)))
    w = np.zeros(dense.shape[1] + size)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        plain, of_slot = dense @ w[:dense.shape[1]], w[dense.shape[1]:]
        error, slope = np.zeros(len(target)), np.zeros(size)
        for docs, slots, n in blocks():
            weight = np.repeat(length[docs], n) * ratio[slots]
            z = plain[docs] + np.bincount(np.repeat(np.arange(len(n)), n), weights=weight * of_slot[slots], minlength=len(n))
            error[docs] = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[docs]
            np.add.at(slope, slots, weight * np.repeat(error[docs], n))
        gradient = np.concatenate([dense.T @ error, slope]) / max(len(target), 1) + ridge * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:dense.shape[1]], w[dense.shape[1]:] * ratio


def _dense(votes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(votes), 1)), votes == -1, votes == 1], axis=1).astype(float)


def classify(docs: DataFrame, labels: DataFrame, sample: int = 8000, threshold: float = 0.75,
             id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
             quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """The documents with ``quality_score`` (the scorer's probability of good) and
    ``quality_accepted``. Most documents of a corpus are good, hence a threshold over a half."""
    spark = docs.sparkSession
    small_batches(spark)
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def vote_rows(batches):
        for batch in batches:
            patterns = [_patterns(votes) for votes, *_ in signals(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.concatenate([*patterns, np.zeros(0, int)]), pa.int32())],
                names=["doc_id", "pattern"])

    id_type = dict(text.dtypes)["doc_id"]
    known = (labels.where(F.col(quality_col).isNotNull() & F.col(toxic_col).isNotNull() & F.col(label_id_col).isNotNull())
             .groupBy(F.col(label_id_col).alias("doc_id"))
             .agg(F.min(((F.col(quality_col) == 1) & (F.col(toxic_col) == 0)).cast("int")).alias("label")))
    patterns = text.mapInArrow(giving_back(vote_rows), f"doc_id {id_type}, pattern int").join(known, "doc_id", "left")
    rows = (patterns.groupBy("pattern", F.coalesce("label", F.lit(NO_LABEL)).alias("label")).count()
            .orderBy("pattern", "label").collect())
    columns = [np.array([r[i] for r in rows], float if i == 2 else int) for i in range(3)]
    posterior = dict(zip(zip(columns[0].tolist(), columns[1].tolist()), label_model(*columns).tolist()))

    # the sample: labelled documents first; its size is a parameter
    picked = (text.where("text is not null").withColumn("text_key", F.xxhash64("text")).select("doc_id", "text_key")
              .join(known, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(NO_LABEL)))
              .orderBy(F.col("label") == NO_LABEL, F.xxhash64("doc_id", "text_key"), "doc_id").limit(sample))
    chosen = (text.withColumn("text_key", F.xxhash64("text"))
              .join(F.broadcast(picked.distinct()), ["doc_id", "text_key"]).select("doc_id", "text", "label")
              .dropDuplicates(["doc_id", "text"]))

    def sample_rows(batches):
        for batch in batches:
            out, labels = [], batch["label"].to_pylist()
            for votes, row, slot, _ in signals(batch["text"]):
                ends = np.searchsorted(row, np.arange(len(votes) + 1))
                # a document's slots ascend: their differences; its weights follow from their number
                out += [(p, b - a, put_ints(np.diff(slot[a:b], prepend=0).astype(np.uint32)))
                        for p, a, b in zip(_patterns(votes).tolist(), ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([x[0] for x in out], pa.int32()), pa.array(labels, pa.int32()),
                 pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())],
                names=["doc_id", "pattern", "label", "n_slots", "slots"])

    got = chosen.mapInArrow(giving_back(sample_rows), f"doc_id {id_type}, pattern int, label int, n_slots int, slots binary"
                            ).toArrow().sort_by([("doc_id", "ascending"), ("pattern", "ascending")])
    pattern, label = got["pattern"].to_pylist(), got["label"].to_pylist()
    sizes = got["n_slots"].to_numpy().astype(np.int64)
    slots = np.empty(int(sizes.sum()), np.int32)
    for end, n, packed in zip(np.cumsum(sizes).tolist(), sizes.tolist(), got["slots"]):
        slots[end - n:end] = np.cumsum(get_ints(packed.as_py(), np.uint32))
    model = train(_unpack(np.array(pattern, int).reshape(-1)) - 1, slots, sizes,
                  np.array([posterior[p, lab] for p, lab in zip(pattern, label)], float))
    del got, slots
    give_back()
    shared = spark.sparkContext.broadcast((model[0], model[1].astype(np.float32)))

    names = [c for c in docs.columns if c not in ("quality_score", "quality_accepted")]
    nested = docs.select(F.struct(*names).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = nested.select("row").withColumn("quality_score", F.lit(0.0)).schema

    def score(batches):
        dense, of_slot = shared.value
        for batch in batches:
            out = []
            for votes, row, slot, weight in signals(batch["text"]):
                z = _dense(votes) @ dense + np.bincount(row, weights=weight * of_slot[slot], minlength=len(votes))
                out.append(1 / (1 + np.exp(-z)))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(np.concatenate([*out, np.zeros(0)]))],
                                             names=["row", "quality_score"])

    return (nested.mapInArrow(giving_back(score), schema).select("row.*", "quality_score")
            .withColumn("quality_accepted", F.col("quality_score") >= threshold))
