"""Katz back-off language model over words, and the log probability of every text.

Order 2. Counts are Good-Turing discounted (r <= K) and the mass set free goes to the
words not seen after the context, by a weight that makes each distribution sum to one:

    p(w | h) = D2(r) r / c(h)             r = c(h w) > 0
             = alpha(h) p(w)              else;  alpha(h) = free(h) / (1 - sum of p(seen))
    p(w)     = D1(c) c / N                c = c(w) > 0
             = free                       the class of all unknown words

A context whose discounts set no mass free gets one count more in its total, which is
the free mass then. An unknown context has alpha = 1. The recursion goes from the bigram
table to the unigram table to the unknown class.

Words meet in key buckets for their training counts; bigrams meet in the bucket of their
context, so a bucket holds each of its contexts whole and is one partition of the stored
model (counts, and what the back-off weight needs). Contexts are split over buckets by
hash; each chunk sends a bigram once, with its count.

Defined cases: a null or empty text is one end token; a null doc_id trains (it has no
remainder); repeated rows train and are scored each; without training tokens every
probability is that of the unknown class, 1; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfetch.llm.chunks import (ChunkTable, answer, base_documents, bits, bucket_of, by_bucket, from_bits,
                                 from_low_bytes, get_ints, get_parts, low_bytes, pack_ids, put_ints, put_parts,
                                 stored, unpack_ids)

K = 5                # counts up to K are discounted
START = 1            # the context before a text's first token; 0: unknown
SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def held_out_id(doc_id: int | None, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def score(docs: DataFrame, folds: int = 7, held_out_fold: int = 2, id_col: str = "doc_id",
          text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """Trains on the documents outside the held-out fold and scores all of them.
    ``model_path``: also writes the bigram table there (bucket, context, word, count)."""
    def pack(doc_ids: pa.Array, texts: pa.Array) -> bytes:
        code_of: dict[bytes, int] = {b"": 0}                       # code 0: the end
        counts, codes = [], []
        for text in texts:
            words = (text.as_py() or b"").lower().split()          # A-Z only, on the six separators
            counts.append(len(words) + 1)
            codes += [code_of.setdefault(w, len(code_of)) for w in words]
            codes.append(0)
        held = np.array([held_out_id(i, folds, held_out_fold) for i in doc_ids.to_pylist()], bool)
        keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in code_of), np.uint64, len(code_of))
        return put_parts(pack_ids(doc_ids), put_ints(np.array(counts, np.int64)), bits(held),
                         low_bytes(keys, 8), put_ints(np.array(codes, np.uint32)))

    chunks = ChunkTable.build(base_documents(docs, id_col, text_col), pack)
    n_keys = chunks.n_keys

    def request_words(body: bytes):
        c = _Chunk(body)
        trained = np.bincount(c.codes[c.trains], minlength=len(c.keys))
        for bucket, i in _routes(c.keys, n_keys):
            yield bucket, len(i), put_parts(low_bytes(c.keys[i], 8), put_ints(trained[i]))

    def count_words(blocks: list[bytes], ns: np.ndarray) -> list[bytes]:
        parts = [get_parts(b) for b in blocks]
        keys, inverse = np.unique(np.concatenate([from_low_bytes(p[0], 8) for p in parts]), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, inverse, np.concatenate([get_ints(p[1], np.int64) for p in parts]))
        bucket = int(bucket_of(keys[:1], n_keys)[0])
        rank = np.empty(len(keys), np.int64)                       # frequent words get small numbers
        rank[np.argsort(-total, kind="stable")] = np.arange(len(keys))
        number = np.where(total > 0, rank * n_keys + bucket + 2, 0)
        ends = np.cumsum(ns)
        out = [put_parts(put_ints(total[inverse[e - n:e]]), put_ints(number[inverse[e - n:e]]))
               for e, n in zip(ends.tolist(), ns.tolist())]
        return [*out, put_ints(_counts_of_counts(total))]

    words = stored(answer(chunks.ask(request_words), count_words, kind=0), "word_counts")
    stats = _sum_stats(words)
    n_train, n_words = stats[0], stats[1]
    first = _Discount(stats[2:], n_train)

    def request_bigrams(body: bytes, answers):
        c = _Chunk(body)
        c.know(answers.get(0, {}), n_keys)
        pairs, inverse = np.unique(c.pairs, return_inverse=True)
        trained = np.bincount(inverse, weights=c.trains[c.paired], minlength=len(pairs)).astype(np.int64)
        context, word = pairs // c.width, pairs % c.width
        for bucket, i, ctx, sizes in _context_routes(c, context, n_keys):
            n = trained[i]
            yield bucket, len(i), put_parts(put_ints(c.number[ctx]), put_ints(sizes), put_ints(c.number[word[i]]),
                                            put_ints(n), put_ints(c.total[word[i]][n > 0]))

    def count_bigrams(blocks: list[bytes], ns: np.ndarray) -> list[bytes]:
        parts = [[get_ints(x, np.int64) for x in get_parts(b)] for b in blocks]
        context = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        word = np.concatenate([p[2] for p in parts])
        n = np.concatenate([p[3] for p in parts])
        c_word = np.zeros(len(n), np.int64)
        c_word[n > 0] = np.concatenate([p[4] for p in parts])
        order = np.lexsort((word, context))
        context, word = context[order], word[order]
        new_context = np.concatenate([[True], context[1:] != context[:-1]])
        new_pair = new_context | np.concatenate([[True], word[1:] != word[:-1]])
        pair_at, context_at = np.flatnonzero(new_pair), np.flatnonzero(new_context)
        r = np.add.reduceat(n[order], pair_at)
        p_seen = np.where(r > 0, first.seen(np.maximum.reduceat(c_word[order], pair_at)), 0.0)
        # per context: sum of p(seen), and how many successors have each small count
        of_pair = np.cumsum(new_context)[pair_at] - 1
        seen = np.bincount(of_pair, weights=p_seen, minlength=len(context_at))
        small = np.stack([np.bincount(of_pair, weights=r == k, minlength=len(context_at)).astype(np.int64)
                          for k in range(1, K + 1)], axis=1)
        mask = (small > 0) @ (1 << np.arange(K))
        r_asked, of_asked = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        r_asked[order] = r[np.cumsum(new_pair) - 1]
        of_asked[order] = np.cumsum(new_context) - 1
        out, at = [], 0
        for p in parts:
            size = len(p[2])
            heads = at + np.cumsum(p[1]) - p[1]
            ctx, mine = of_asked[heads], r_asked[at:at + size]
            unseen = np.maximum.reduceat(mine == 0, heads - at)
            out.append(put_parts(put_ints(mine), put_ints(mask[ctx].astype(np.uint8)), bits(unseen),
                                 seen[ctx[unseen]].tobytes(), put_ints(small[ctx[unseen]].reshape(-1))))
            at += size
        kept = r > 0
        model = put_parts(put_ints(context[pair_at][kept]), put_ints(word[pair_at][kept]), put_ints(r[kept]))
        return [*out, put_parts(_counts_of_counts_block(r), model)]

    bigrams = stored(answer(chunks.ask_again(words, request_bigrams), count_bigrams, kind=1), "bigram_counts")
    if model_path:
        _model_rows(bigrams).write.partitionBy("bucket").parquet(model_path)
    second = _Discount(_sum_stats(bigrams, nested=True)[2:], None)

    def result(body: bytes, answers) -> pa.Table:
        c = _Chunk(body)
        c.know(answers.get(0, {}), n_keys)
        pairs, inverse = np.unique(c.pairs, return_inverse=True)
        context, word = pairs // c.width, pairs % c.width
        log_p = first.log_p(c.total)
        log_pair = np.empty(len(pairs))
        for bucket, i, ctx, sizes in _context_routes(c, context, n_keys):
            r, mask, unseen, seen, small = get_parts(answers[1][bucket])
            r, mask = get_ints(r, np.int64), get_ints(mask, np.uint8)
            unseen = from_bits(unseen, len(ctx))
            free = np.zeros(len(ctx))
            free[unseen] = get_ints(small, np.int64).reshape(-1, K) @ second.freed()
            # no mass set free: one count more
            plus_one = mask & sum(1 << k for k, f in enumerate(second.freed()) if f > 0) == 0
            total = c.total[ctx] + plus_one
            free[plus_one] = 1
            rest = np.ones(len(ctx))
            rest[unseen] = 1 - np.frombuffer(seen)
            with np.errstate(divide="ignore"):
                alpha = np.log10(free / total / rest)
                log_seen = np.log10(second.seen(r) / np.repeat(total, sizes))
            log_pair[i] = np.where(r > 0, log_seen, np.repeat(alpha, sizes) + log_p[word[i]])
        tokens = log_p[c.codes]
        tokens[c.paired] = log_pair[inverse]
        base = np.log10((c.total[c.codes] + 1) / (n_train + n_words + 1))
        starts = np.cumsum(c.counts) - c.counts
        sums = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0, x.dtype)
        return pa.table({
            "doc_id": c.ids, "held_out": pa.array(c.held, pa.bool_()), "n_tokens": pa.array(c.counts, pa.int64()),
            "n_known": pa.array(sums((c.total[c.codes] > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(c.counts), n_train), pa.int64()),
            "base_score": pa.array(sums(base), pa.float64()), "score": pa.array(sums(tokens), pa.float64())})

    return chunks.finish(words.unionByName(bigrams), result, SCHEMA)


class _Discount:
    """Good-Turing factors D(r) from the counts of counts n(1) .. n(K + 1)."""

    def __init__(self, n: list[int], total: int | None):
        self.factor = [1.0] * K
        if all(n):
            a = (K + 1) * n[K] / n[0]
            for r in range(1, K + 1):
                d = ((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a) if a != 1 else 1.0
                self.factor[r - 1] = d if 0 < d < 1 else 1.0     # out of range: not discounted
        self.total = total
        if total is not None:
            free = sum((1 - d) * r * n[r - 1] for r, d in enumerate(self.factor, 1))
            self.total, self.free = (total, free / total) if free > 0 else (total + 1, 1 / (total + 1))

    def freed(self) -> np.ndarray:
        """What one successor of count r = 1 .. K sets free."""
        return (1 - np.array(self.factor)) * np.arange(1, K + 1)

    def seen(self, r: np.ndarray) -> np.ndarray:
        """D(r) r, over the total if there is one."""
        out = r * np.concatenate([[1.0], self.factor, [1.0]])[np.minimum(r, K + 1)]
        return out if self.total is None else out / self.total

    def log_p(self, c: np.ndarray) -> np.ndarray:
        return np.log10(np.where(c > 0, self.seen(c), self.free))


class _Chunk:
    def __init__(self, body: bytes):
        ids, counts, held, keys, codes = get_parts(body)
        self.ids, self.counts = unpack_ids(ids), get_ints(counts, np.int64)
        self.held = from_bits(held, len(self.counts))
        self.keys, self.codes = from_low_bytes(keys, 8), get_ints(codes, np.uint32).astype(np.int64)
        self.trains = np.repeat(~self.held, self.counts)

    def know(self, blocks: dict[int, bytes], n_keys: int) -> None:
        """Training counts and numbers of the chunk's words, and its (context, word) pairs."""
        n = len(self.keys)
        self.total, self.number = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for bucket, i in _routes(self.keys, n_keys):
            total, number = get_parts(blocks[bucket])
            self.total[i], self.number[i] = get_ints(total, np.int64), get_ints(number, np.int64)
        self.total[n], self.number[n] = self.total[0], START       # as many starts as ends
        before = np.concatenate([[n], self.codes[:-1]])[:len(self.codes)]
        before[(np.cumsum(self.counts) - self.counts)] = n
        self.width = n + 1
        self.paired = np.flatnonzero(self.total[before] > 0)       # tokens after a known context
        self.pairs = before[self.paired] * self.width + self.codes[self.paired]


def _routes(keys: np.ndarray, n: int):
    buckets = bucket_of(keys, n)
    order = np.argsort(buckets, kind="stable")
    for bucket, run in by_bucket(buckets[order]):
        yield bucket, order[run]


def _context_routes(c: _Chunk, context: np.ndarray, n: int):
    """Per bucket: the pairs, their distinct contexts and the pairs of each."""
    buckets = bucket_of(c.number.astype(np.uint64), n)[context]
    order = np.argsort(buckets, kind="stable")                     # pairs are sorted by context
    for bucket, run in by_bucket(buckets[order]):
        i = order[run]
        ctx, sizes = np.unique(context[i], return_counts=True)
        yield bucket, i, ctx, sizes.astype(np.int64)


def _counts_of_counts(total: np.ndarray) -> np.ndarray:
    small = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1:K + 2]
    return np.concatenate([[total.sum(), (total > 0).sum()], small]).astype(np.int64)


def _counts_of_counts_block(r: np.ndarray) -> bytes:
    return put_ints(_counts_of_counts(r))


def _sum_stats(answers: DataFrame, nested: bool = False) -> list[int]:
    """Sums over the key buckets: tokens, distinct keys, n(1) .. n(K + 1)."""
    names = [f"s{i}" for i in range(K + 3)]

    def unpack(batches):
        for batch in batches:
            rows = [get_ints(get_parts(b.as_py())[0] if nested else b.as_py(), np.int64) for b in batch["body"]]
            table = np.array(rows, np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([pa.array(table[:, i]) for i in range(len(names))], names=names)

    sums = (answers.where("chunk = -1").select("body")
            .mapInArrow(unpack, ", ".join(f"{x} long" for x in names))
            .agg(*(F.sum(x).alias(x) for x in names)).first())
    return [int(x or 0) for x in sums]


def _model_rows(answers: DataFrame) -> DataFrame:
    def unpack(batches):
        for batch in batches:
            for bucket, body in zip(batch["bucket"], batch["body"]):
                context, word, r = (get_ints(x, np.int64) for x in get_parts(get_parts(body.as_py())[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(r), bucket.as_py()), pa.int32()), pa.array(context), pa.array(word),
                     pa.array(r)], names=["bucket", "context", "word", "n"])

    return (answers.where("chunk = -1").select("bucket", "body")
            .mapInArrow(unpack, "bucket int, context long, word long, n long"))
