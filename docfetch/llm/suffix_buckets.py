"""Suffix dedup by bucket refinement over bytes.

Suffixes fall into buckets by their first bytes; a bucket's identifier is refined by
the identifier of the suffix some bytes later, and the refined identifiers are used
for the next refinement: 25 bytes, then 50, 100 and 200. An identifier is a 64-bit
name of the bucket, equal wherever the bytes are equal, so suffixes of different
documents compare without one global sort. Runs are compared by the names of their
anchor and of their bytes (112 bits), strings by 96 bits.

Only suffixes that can share a bucket are refined to the end. Each 200-byte string
is filed under one of the 100-byte buckets inside it (the least identifier, the
leftmost of equals), which its bytes alone determine; consecutive strings mostly
share that bucket and form a run. A run whose bucket has no other member is unique. A
run equal to another run as a whole is repeated as a whole. The strings of the
remaining runs are refined to 200 bytes and compared one by one.

Bytes covered by a string that also starts elsewhere are removed, in every copy.

Defined cases: null and empty texts have no bytes; matches never cross documents;
rows that repeat (also with one doc_id) are documents of their own, so their bytes
repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from docfetch.llm.chunks import (ChunkTable, answer, base_documents, bits, bucket_of, by_bucket, from_bits,
                                 from_low_bytes, get_ints, get_parts, low_bytes, mix, pack_texts, pieces, put_ints,
                                 put_parts, stored, unpack_texts)
from docfetch.llm.keys import combine, distinct_pairs, eights

FIRST = 25           # bytes of the initial buckets
ANCHOR_BYTES = 6     # of an anchor's key, besides its bucket: a clash only compares more strings
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
UNIQUE, WHOLE, LENDS, ASKS = 0, 1, 2, 3


def dedup_suffixes(docs: DataFrame, doublings: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and ``kept``, the remaining bytes.
    The string length is 25 bytes doubled ``doublings`` times (200)."""
    if doublings < 1:
        raise ValueError("at least one refinement")

    def pack(doc_ids: pa.Array, texts: pa.Array) -> bytes:
        return _Runs.pack(pack_texts(doc_ids, texts), doublings)

    chunks = ChunkTable.build(base_documents(docs, id_col, text_col), pack)
    n_keys = chunks.n_keys

    def request_runs(body: bytes):
        runs = _Runs(body, doublings)
        keys, first, counts = np.unique(runs.context, return_index=True, return_counts=True)
        anchors = runs.anchor[first]
        for bucket, i in _routes(anchors, n_keys):
            yield bucket, len(i), put_parts(low_bytes(anchors[i], ANCHOR_BYTES), low_bytes(keys[i], 8),
                                            bits(counts[i] > 1))

    def compare_runs(blocks: list[bytes], ns: np.ndarray) -> list[bytes]:
        parts = [get_parts(b) for b in blocks]
        anchors = np.concatenate([from_low_bytes(p[0], ANCHOR_BYTES) for p in parts])
        contexts = np.concatenate([from_low_bytes(p[1], 8) for p in parts])
        weight = 1 + np.concatenate([from_bits(p[2], n) for p, n in zip(parts, ns)]).astype(np.int64)
        order = np.lexsort((contexts, anchors))
        a, c = anchors[order], contexts[order]
        new_anchor = np.concatenate([[True], a[1:] != a[:-1]])
        new_context = new_anchor | np.concatenate([[True], c[1:] != c[:-1]])
        firsts, heads = np.flatnonzero(new_context), np.flatnonzero(new_anchor)
        repeated = np.repeat(np.add.reduceat(weight[order], firsts) > 1, np.diff(np.append(firsts, len(a))))
        mixed = np.repeat(np.add.reduceat(new_context.astype(np.int64), heads) > 1, np.diff(np.append(heads, len(a))))
        # one of the equal runs lends its strings to the others of its bucket
        state = np.where(repeated, np.where(mixed & new_context, LENDS, WHOLE), np.where(mixed, ASKS, UNIQUE))
        out = np.empty(len(a), np.uint8)
        out[order] = state
        ends = np.cumsum(ns)
        return [put_parts(bits(out[e - n:e] & 1), bits(out[e - n:e] & 2))
                for e, n in zip(ends.tolist(), ns.tolist())]

    def request_strings(body: bytes, answers):
        runs = _Runs(body, doublings)
        keys, checks, _ = runs.strings(runs.states(answers.get(0, {}), n_keys))
        first, same = distinct_pairs(keys, checks)
        keys, checks, counts = keys[first], checks[first], np.bincount(same, minlength=len(first))
        for bucket, i in _routes(keys, n_keys):
            yield bucket, len(i), put_parts(low_bytes(keys[i], 8), checks[i].tobytes(), bits(counts[i] > 1))

    def compare_strings(blocks: list[bytes], ns: np.ndarray) -> list[bytes]:
        parts = [get_parts(b) for b in blocks]
        keys = np.concatenate([from_low_bytes(p[0], 8) for p in parts])
        checks = np.concatenate([np.frombuffer(p[1], np.uint32) for p in parts])
        weight = 1 + np.concatenate([from_bits(p[2], n) for p, n in zip(parts, ns)]).astype(np.int64)
        _, same = distinct_pairs(keys, checks)
        repeated = (np.bincount(same, weights=weight) > 1)[same]
        ends = np.cumsum(ns)
        return [bits(repeated[e - n:e]) for e, n in zip(ends.tolist(), ns.tolist())]

    def result(body: bytes, answers) -> pa.Table:
        runs = _Runs(body, doublings)
        states = runs.states(answers.get(0, {}), n_keys)
        asked, checks, at = runs.strings(states)
        first, inverse = distinct_pairs(asked, checks)
        keys = asked[first]
        repeated = np.zeros(len(keys), bool)
        for bucket, i in _routes(keys, n_keys):
            repeated[i] = from_bits(answers[1][bucket], len(i))
        return runs.kept(states, at[repeated[inverse]])

    states = stored(answer(chunks.ask(request_runs), compare_runs, kind=0), "run_states")
    strings = answer(chunks.ask_again(states, request_strings), compare_strings, kind=1)
    return chunks.finish(states.unionByName(strings), result, SCHEMA)


class _Runs:
    """The runs of a chunk: strings first..last share the anchor bucket at ``at``."""

    def __init__(self, body: bytes, doublings: int):
        texts, first, size, anchor, context = get_parts(body)
        self._texts(texts, doublings)
        self.first = np.cumsum(get_ints(first, np.int64))
        self.last = self.first + get_ints(size, np.int64)
        self.anchor, self.context = np.frombuffer(anchor, "<u8"), np.frombuffer(context, "<u8")

    @classmethod
    def pack(cls, texts: bytes, doublings: int) -> bytes:
        """A chunk's body: its texts and their runs, which every pass over the chunk reads."""
        runs = cls.__new__(cls)
        runs._texts(texts, doublings)
        found = [runs._runs(a, b) for a, b in pieces(runs.lengths)]
        kinds = (np.int64, np.int64, "<u8", "<u8")
        first, last, anchor, context = (
            np.concatenate([*(f[k] for f in found), np.zeros(0, kind)]) for k, kind in enumerate(kinds))
        return put_parts(texts, put_ints(np.diff(first, prepend=0)), put_ints(last - first),
                         anchor.tobytes(), context.tobytes())

    def _texts(self, texts: bytes, doublings: int) -> None:
        self.ids, self.lengths, self.data = unpack_texts(texts)
        self.buf = np.frombuffer(self.data, np.uint8)
        self.size, self.doublings = FIRST << doublings, doublings
        ends = np.cumsum(np.maximum(self.lengths, 0))
        self.begin, self.end = ends - np.maximum(self.lengths, 0), ends

    def _names(self, text: np.ndarray, levels: int):
        """Bucket identifiers of every suffix at FIRST bytes, and at FIRST << levels bytes."""
        n, view = max(len(text) - FIRST + 1, 0), eights(text)
        names = mix(text[FIRST - 1:].astype(np.uint64) + np.uint64(1))[:n]
        for at in range(0, FIRST - 1, 8):
            names = combine(names, view[at:at + n])
        first = names
        for level in range(levels):
            later = FIRST << level
            names = combine(names[:-later], names[later:]) if len(names) > later else names[:0]
        return first, names

    def _runs(self, a: int, b: int):
        shift = self.begin[a]
        text = self.buf[shift:self.end[b - 1]]
        _, names = self._names(text, self.doublings - 1)
        half = self.size // 2
        n = len(text) - self.size + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
        # least identifier of the half + 1 buckets inside each string, the leftmost of equals
        place = np.arange(len(names), dtype=np.uint64)
        width = np.uint64(max(1, int(len(names)).bit_length()))
        least, reach = (names >> width << width) | place, 1
        while reach * 2 <= half + 1:
            least, reach = np.minimum(least[:-reach], least[reach:]), reach * 2
        rest = half + 1 - reach
        least = np.minimum(least[:len(least) - rest], least[rest:])[:n]
        at = (least & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)
        inside = np.zeros(n, bool)
        new = np.zeros(n, bool)
        for s, e in zip((self.begin[a:b] - shift).tolist(), (self.end[a:b] - shift).tolist()):
            if e - s >= self.size:
                inside[s:e - self.size + 1] = True
                new[s] = True
        new[1:] |= at[1:] != at[:-1]
        new &= inside
        stop = np.append(~inside[1:] | new[1:], True) & inside
        first, last = np.flatnonzero(new), np.flatnonzero(stop)
        held, size = memoryview(self.data)[int(shift):], self.size
        context = np.fromiter((xxhash.xxh3_64_intdigest(held[i:j + size]) for i, j in zip(first.tolist(), last.tolist())),
                              np.uint64, len(first))
        anchor_at = at[first]
        context = mix(context ^ mix((anchor_at - first).astype(np.uint64) << np.uint64(32)
                                    | (last - first).astype(np.uint64)))
        return first + shift, last + shift, names[anchor_at], context

    def states(self, blocks: dict[int, bytes], n_keys: int) -> np.ndarray:
        _, first, inverse = np.unique(self.context, return_index=True, return_inverse=True)
        out = np.zeros(len(first), np.uint8)
        for bucket, i in _routes(self.anchor[first], n_keys):
            low, high = get_parts(blocks[bucket])
            out[i] = from_bits(low, len(i)) + 2 * from_bits(high, len(i)).astype(np.uint8)
        return out[inverse]

    def strings(self, states: np.ndarray):
        """Keys, checks and places of the strings of the runs that lend or ask (a lender once)."""
        picked = np.flatnonzero(states >= LENDS)
        _, once = np.unique(self.context[picked], return_index=True)
        picked = picked[np.sort(once)]
        n = self.last[picked] - self.first[picked] + 1
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[picked] - (ends - n), n)
        keys, checks = np.empty(len(at), np.uint64), np.zeros(len(at), np.uint64)
        done = 0
        for a, b in pieces(self.lengths):
            upto = int(np.searchsorted(at, self.end[b - 1]))
            if upto > done:
                shift = self.begin[a]
                parts, names = self._names(self.buf[shift:self.end[b - 1]], self.doublings)
                here = at[done:upto] - shift
                keys[done:upto] = names[here]
                for part in range(0, self.size, FIRST):
                    checks[done:upto] = combine(parts[here + part], checks[done:upto])
            done = max(done, upto)
        return keys, checks.astype(np.uint32), at

    def kept(self, states: np.ndarray, single: np.ndarray) -> pa.Table:
        """Removes the whole runs and the single strings found repeated."""
        change = np.zeros(len(self.buf) + 1, np.int32)
        whole = (states == WHOLE) | (states == LENDS)
        np.add.at(change, self.first[whole], 1)
        np.add.at(change, self.last[whole] + self.size, -1)
        np.add.at(change, single, 1)
        np.add.at(change, single + self.size, -1)
        removed = np.cumsum(change[:-1]) > 0
        starts = removed & ~np.concatenate([[False], removed[:-1]]) if len(removed) else removed
        total, spans = np.concatenate([[0], np.cumsum(removed)]), np.concatenate([[0], np.cumsum(starts)])
        n_removed = total[self.end] - total[self.begin]
        # a run that begins at a document's first byte counts also when the one before ended removed
        n_spans = spans[self.end] - spans[self.begin]
        n_spans += [bool(b < e and removed[b] and not starts[b]) for b, e in zip(self.begin, self.end)]
        kept = [self.data[b:e] if not n else self.buf[b:e][~removed[b:e]].tobytes()
                for b, e, n in zip(self.begin.tolist(), self.end.tolist(), n_removed.tolist())]
        return pa.table({"doc_id": self.ids, "n_bytes": pa.array(self.end - self.begin, pa.int64()),
                         "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()),
                         "kept": pa.array(kept, pa.binary())})


def _routes(keys: np.ndarray, n: int):
    buckets = bucket_of(keys, n)
    order = np.argsort(buckets, kind="stable")
    for bucket, run in by_bucket(buckets[order]):
        yield bucket, order[run]
