"""Words of a batch of texts as 64-bit keys, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from docfetch.llm.chunks import byte_values, pieces, prefix_sums, span_hash
from docfetch.llm.keys import byte_keys, combine, window_keys

PIECE = 1 << 18      # bytes of text worked on at once: a few MB of arrays
SEPARATOR = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
#: ASCII other than letters and digits
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_keys(texts: pa.Array, lower: bool = True,
              separator: np.ndarray = SEPARATOR) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of documents: the first one's index, the keys of their words in order, and
    the number of words of each document (null: none)."""
    for a, sums, begin, end, counts in word_spans(texts, lower, separator):
        yield a, span_hash(sums, begin, end), counts


def word_spans(texts: pa.Array, lower: bool = True, separator: np.ndarray = SEPARATOR):
    """As ``word_keys``, with the prefix sums and the words' places instead of their keys."""
    values = byte_values()[LOWER] if lower else byte_values()
    for a, text, ends in text_bytes(texts):
        starts = np.concatenate([[0], ends[:-1]])
        begin, end = word_places(text, starts, separator)
        doc = np.searchsorted(starts, begin, side="right") - 1
        yield a, prefix_sums(values[text]), begin, end, np.bincount(doc, minlength=len(ends))


def text_bytes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of documents: the first one's index, their bytes and where each one ends."""
    texts = texts.cast(pa.binary())
    lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in pieces(lengths, PIECE):
        yield (a, np.frombuffer(b"".join(x.as_py() or b"" for x in texts[a:b]), np.uint8), np.cumsum(lengths[a:b]))


def word_places(text: np.ndarray, starts: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; a word also ends where a document does."""
    inside = ~separator[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[starts] = True
    edge[-1] = True
    no = np.zeros(min(1, len(text)), bool)
    before, after = np.concatenate([no, inside[:-1]]), np.concatenate([inside[1:], no])
    return (np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Per document the sorted distinct keys of its n-word shingles; of the whole text if
    it has fewer words, none if it has no word."""
    for _, text, ends in text_bytes(texts):
        text, starts = LOWER[text], np.concatenate([[0], ends[:-1]])
        begin, end = word_places(text, starts)
        words = byte_keys(text, begin, end)
        counts = np.bincount(np.searchsorted(starts, begin, side="right") - 1, minlength=len(ends))
        keys = window_keys(words, n)
        first = 0
        for count in counts.tolist():
            if count >= n:
                yield np.unique(keys[first:first + count - n + 1])
            elif count:
                yield _whole(words[first:first + count])
            else:
                yield keys[:0]
            first += count


def _whole(words: np.ndarray) -> np.ndarray:
    """The key of a text of fewer words than a shingle has; their number tells it from a shingle's."""
    out = np.array([len(words)], np.uint64)
    for word in words:
        out = combine(out, np.array([word]))
    return out
