"""Keys of words and of word windows that different texts do not share.

A word's key is a chained hash of its bytes, eight at a time; a window's key combines the
keys of its halves, level by level. No step is linear, so no arrangement of words (such as
Thue-Morse sequences, which every polynomial modulo 2**64 confuses) has a key in common
with another one but by chance. Where chance alone matters (keys compared over the whole
corpus), ``window_checks`` gives 32 bits more.
"""

from __future__ import annotations

import numpy as np
import xxhash

from docfetch.llm.chunks import mix, mix_pairs

BLOCKS = 8           # of 8 bytes; longer words are hashed one by one
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as integers (zeros behind the end)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray(len(text) + 1, "<u8", padded, strides=(1,))


def byte_keys(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit keys of the spans begin .. end of ``text``."""
    view, size = eights(text), end - begin
    out = mix(size.astype(np.uint64) * _OTHER)
    todo, at = np.arange(len(begin)), 0
    while len(todo) and at < 8 * BLOCKS:
        left = np.minimum(size[todo] - at, 8)
        block = view[begin[todo] + at]
        block &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - left).astype(np.uint64))
        out[todo] = combine(out[todo], block)
        at += 8
        todo = todo[size[todo] > at]
    for i in todo.tolist():
        out[i] = xxhash.xxh3_64_intdigest(text[begin[i]:end[i]].tobytes(), seed=1)
    return out


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """An ordered pair's key."""
    return mix_pairs(left, right, _FACTOR)


def window_keys(words: np.ndarray, n: int) -> np.ndarray:
    """The key of the n words from each place; places with fewer words left have no meaning."""
    level = np.concatenate([words, np.zeros(n, np.uint64)])
    out, done, size = None, 0, 1
    while size <= n:
        if n & size:
            part = level[done:done + len(words)]
            out = mix(part) if out is None else combine(out, part)
            done += size
        size *= 2
        if size <= n:
            level = combine(level, np.concatenate([level[size // 2:], np.zeros(size // 2, np.uint64)]))
    return out


def window_checks(words: np.ndarray, n: int) -> np.ndarray:
    """32 bits beside the key, from other keys of the same words."""
    return window_keys(mix(words ^ _OTHER), n).astype(np.uint32)


def distinct_pairs(keys: np.ndarray, checks: np.ndarray):
    """The distinct (key, check) pairs: where each first occurs, and which one each is."""
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    inverse = np.empty(len(k), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse
