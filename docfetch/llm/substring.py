"""Exact substring dedup over words with fixed-block anchors.

Every document is cut into non-overlapping blocks of half a window; the blocks of all
documents are the index. Every rolling block of every document probes it. A window
of 2b words contains a whole indexed block wherever it starts, so a window that
repeats has a hit in each of its occurrences. Hits are extended to every window that
holds one, and a window goes when the same word sequence starts earlier; adjacent
windows join to maximal repeats.

Earlier: a smaller doc_id, or the same document and an earlier start. Words covered
by such a window are removed; windows are judged on the input. Windows are compared over
the corpus by 96 bits: two independent keys of their words.

Defined cases: null and empty texts have no words; a null doc_id comes before all
others; rows that share a doc_id are separate documents, neither earlier than the
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docfetch.llm.chunks import (ChunkTable, answer, base_documents, bits, bucket_of, by_bucket, from_bits,
                                 from_low_bytes, get_ints, get_parts, low_bytes, order_of, pack_texts, pieces,
                                 put_ints, put_parts, stored, unpack_texts)
from docfetch.llm.keys import byte_keys, distinct_pairs, window_checks, window_keys

SEPARATOR = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
PROBE_BYTES = 6      # of a probe's key, besides its bucket: a filter, checked by the window's key
SCHEMA = "doc_id long, n_words long, n_removed long, kept string"


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_removed, and ``kept``, the kept words joined by a space."""
    block = window // 2
    if window < 2:
        raise ValueError("a window has two words at least")
    chunks = ChunkTable.build(base_documents(docs, id_col, text_col), pack_texts)
    n_keys = chunks.n_keys

    def request_blocks(body: bytes):
        words = _Words(body, block, window)
        keys, counts = np.unique(words.blocks, return_counts=True)
        indexed = np.isin(keys, words.blocks[words.block_pos % block == 0])
        for bucket, i in _routes(keys, n_keys):
            yield bucket, len(i), put_parts(low_bytes(keys[i], PROBE_BYTES), bits(indexed[i]), bits(counts[i] > 1))

    def probe(blocks: list[bytes], ns: np.ndarray) -> list[bytes]:
        parts = [get_parts(b) for b in blocks]
        keys = np.concatenate([from_low_bytes(p[0], PROBE_BYTES) for p in parts])
        indexed = np.concatenate([from_bits(p[1], n) for p, n in zip(parts, ns)])
        weight = 1 + np.concatenate([from_bits(p[2], n) for p, n in zip(parts, ns)]).astype(np.int64)
        order, first = _groups(keys)
        hit = np.maximum.reduceat(indexed[order], first) & (np.add.reduceat(weight[order], first) > 1)
        return _split_bits(_spread(hit, order, first), ns)

    def request_windows(body: bytes, answers):
        words = _Words(body, block, window)
        keys, checks, owners, _ = words.owners(_block_hits(words, answers.get(0, {}), n_keys))
        for bucket, i in _routes(keys, n_keys):
            yield bucket, len(i), put_parts(low_bytes(keys[i], 8), checks[i].tobytes(), put_ints(owners[i]))

    def earlier(blocks: list[bytes], ns: np.ndarray) -> list[bytes]:
        parts = [get_parts(b) for b in blocks]
        keys = np.concatenate([from_low_bytes(p[0], 8) for p in parts])
        checks = np.concatenate([np.frombuffer(p[1], np.uint32) for p in parts])
        owners = np.concatenate([get_ints(p[2], np.int64) for p in parts])
        first, same = distinct_pairs(keys, checks)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, same, owners)
        return _split_bits(least[same] < owners, ns)

    def result(body: bytes, answers) -> pa.Table:
        words = _Words(body, block, window)
        hits = _block_hits(words, answers.get(0, {}), n_keys)
        keys, _, owners, (at, inverse) = words.owners(hits)
        gone_elsewhere = _gather_bits(keys, answers.get(1, {}), n_keys)
        order = words.order[words.doc[at]]
        gone = gone_elsewhere[inverse] | (order > owners[inverse])
        # the owner's own later starts: of equal windows in one document all but the first
        seen = np.lexsort((at, words.doc[at], inverse))
        same = np.zeros(len(at), bool)
        same[seen[1:]] = ((inverse[seen[1:]] == inverse[seen[:-1]])
                          & (words.doc[at][seen[1:]] == words.doc[at][seen[:-1]]))
        return words.kept(at[gone | same])

    hits = stored(answer(chunks.ask(request_blocks), probe, kind=0), "block_hits")
    dups = answer(chunks.ask_again(hits, request_windows), earlier, kind=1)
    return chunks.finish(hits.unionByName(dups), result, SCHEMA)


class _Words:
    """The words of a chunk: keys of the rolling blocks and windows, by word position."""

    def __init__(self, body: bytes, block: int, window: int):
        self.ids, self.lengths, self.data = unpack_texts(body)
        self.order = order_of(self.ids)
        self.window, self.block = window, block
        docs, blocks, windows, checks, places = [], [], [], [], []
        buf = np.frombuffer(self.data, np.uint8)
        ends = np.cumsum(np.maximum(self.lengths, 0))
        starts = ends - np.maximum(self.lengths, 0)
        for a, b in pieces(self.lengths):
            text = buf[starts[a]:ends[b - 1]]
            inside = ~SEPARATOR[text]
            edge = np.zeros(len(text) + 1, bool)
            edge[starts[a:b] - starts[a]] = True
            edge[-1] = True
            before = np.concatenate([[False], inside[:-1]]) if len(text) else inside
            after = np.concatenate([inside[1:], [False]]) if len(text) else inside
            begin = np.flatnonzero(inside & (~before | edge[:-1]))
            end = np.flatnonzero(inside & (~after | edge[1:])) + 1
            doc = np.searchsorted(starts[a:b] - starts[a], begin, side="right") - 1 + a
            # an empty document starts where the next one does: take the last that starts there
            words = byte_keys(text, begin, end)
            count = np.bincount(doc - a, minlength=b - a)
            place = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
            left = np.repeat(count, count) - place
            blocks.append(np.where(left >= block, window_keys(words, block), 0))
            windows.append(np.where(left >= window, window_keys(words, window), 0))
            checks.append(window_checks(words, window))
            docs.append(doc)
            places.append(place)
        join = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)])
        self.doc, self.place = join(docs, np.int64), join(places, np.int64)
        self.count = np.bincount(self.doc, minlength=len(self.lengths))
        left = np.repeat(self.count, self.count) - self.place
        self.block_at = np.flatnonzero(left >= block)
        self.window_ok = left >= window
        self.blocks = join(blocks, np.uint64).astype(np.uint64)[self.block_at]
        self.block_pos = self.place[self.block_at]
        self.windows = join(windows, np.uint64).astype(np.uint64)
        self.checks = join(checks, np.uint32).astype(np.uint32)

    def owners(self, hit: np.ndarray):
        """The distinct windows that hold a hit: key, check, least document order, and where each starts."""
        marks = np.zeros(len(self.doc) + 1, np.int64)
        marks[self.block_at + 1] = hit
        total = np.cumsum(marks)
        at = np.flatnonzero(self.window_ok)
        at = at[total[at + self.window - self.block + 1] > total[at]]
        first, inverse = distinct_pairs(self.windows[at], self.checks[at])
        owners = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(owners, inverse, self.order[self.doc[at]])
        return self.windows[at][first], self.checks[at][first], owners, (at, inverse)

    def kept(self, gone: np.ndarray) -> pa.Table:
        change = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(change, gone, 1)
        np.add.at(change, gone + self.window, -1)
        removed = np.cumsum(change)[:-1] > 0
        n_removed = np.bincount(self.doc[removed], minlength=len(self.lengths))
        texts, at, first = [], 0, 0
        for size, n, cut in zip(np.maximum(self.lengths, 0).tolist(), self.count.tolist(), n_removed.tolist()):
            words = self.data[at:at + size].split()          # on the same six separators
            if cut:
                keep = ~removed[first:first + n]
                words = [w for w, k in zip(words, keep.tolist()) if k]
            texts.append(b" ".join(words).decode())
            at, first = at + size, first + n
        return pa.table({"doc_id": self.ids, "n_words": pa.array(self.count, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(texts, pa.string())})


def _routes(keys: np.ndarray, n: int):
    buckets = bucket_of(keys, n)
    order = np.argsort(buckets, kind="stable")
    for bucket, run in by_bucket(buckets[order]):
        yield bucket, order[run]


def _gather_bits(keys: np.ndarray, blocks: dict[int, bytes], n: int) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    for bucket, i in _routes(keys, n):
        out[i] = from_bits(blocks[bucket], len(i))
    return out


def _block_hits(words: _Words, blocks: dict[int, bytes], n: int) -> np.ndarray:
    keys, inverse = np.unique(words.blocks, return_inverse=True)
    return _gather_bits(keys, blocks, n)[inverse]


def _groups(keys: np.ndarray):
    """The order that sorts the keys, and where each group of equal keys begins."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    return order, np.concatenate([[0], np.flatnonzero(ranked[1:] != ranked[:-1]) + 1])


def _spread(per_group: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), per_group.dtype)
    out[order] = np.repeat(per_group, np.diff(np.append(first, len(order))))
    return out


def _split_bits(flags: np.ndarray, ns: np.ndarray) -> list[bytes]:
    ends = np.cumsum(ns)
    return [bits(flags[e - n:e]) for e, n in zip(ends.tolist(), ns.tolist())]
