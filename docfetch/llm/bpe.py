"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are split into pre-tokens with their positions (a code per position into the
chunk's own word list). The distinct words of all chunks meet in key buckets, where
each is encoded once; the ids go back to the chunks that hold the word, and every
document is reassembled by position. Decoding joins the token-byte table.

Defined cases: a null or empty text has no tokens (and decodes to empty bytes);
repeated rows are encoded each; rows keep their multiplicity; an empty table gives
an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfetch.llm.chunks import (ChunkTable, answer, base_documents, bucket_of, by_bucket, get_ints,
                                 get_parts, pack_ids, put_ints, put_parts, squeeze, expand, unpack_ids)

IDS_SCHEMA = "doc_id long, ids binary"


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The rank file, one 'base64 rank' pair a line (a vocabulary: bounded, about 1 MB)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _splitter(pattern: str):
    import regex

    # white space as the Unicode property: the engine of the rank files' own library
    # takes no separators U+001C..U+001F as white space
    return regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]")
                         .replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


class _Encoders:
    """One tiktoken encoding per worker process, rank table and pattern."""

    held: dict[tuple[int, str], object] = {}

    @classmethod
    def get(cls, pattern: str, ranks_var):
        key = ranks_var.value["key"], pattern
        if key not in cls.held:
            import tiktoken

            cls.held[key] = tiktoken.Encoding("ranks", pat_str=pattern, special_tokens={},
                                              mergeable_ranks=ranks_var.value["ranks"])
        return cls.held[key]


def _share(spark: SparkSession, ranks: dict[bytes, int]):
    return spark.sparkContext.broadcast({"ranks": ranks, "key": hash(frozenset(ranks.items()))})


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids as little-endian unsigned 32-bit integers."""
    return _encode(docs, ranks, pattern, id_col, text_col)


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ``decode`` of ``encode``, with the decoding of a chunk's ids
    in the worker that put them together. Two Arrow functions in a row would hold two
    Python workers a core, each with its own vocabulary."""
    return _encode(docs, ranks, pattern, id_col, text_col, with_decoded=True)


def _encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str, text_col: str,
            with_decoded: bool = False) -> DataFrame:
    spark = docs.sparkSession
    shared = _share(spark, ranks)

    def pack(doc_ids: pa.Array, texts: pa.Array) -> bytes:
        find = _splitter(pattern).findall
        code_of: dict[str, int] = {}
        counts, codes = [], []
        for text in texts:
            words = find(text.as_py().decode()) if text.is_valid else []
            counts.append(len(words))
            codes.append(np.fromiter((code_of.setdefault(w, len(code_of)) for w in words), np.uint32, len(words)))
        words = [w.encode() for w in code_of]
        return put_parts(pack_ids(doc_ids), put_ints(np.array(counts, np.int64)),
                         put_ints(np.concatenate([*codes, np.zeros(0, np.uint32)])), *_pack_words(words))

    chunks = ChunkTable.build(base_documents(docs, id_col, text_col), pack)
    n_keys = chunks.n_keys

    def request(body: bytes):
        parts = get_parts(body)
        words = _unpack_words(*parts[3:5])
        buckets, order = _word_buckets(words, n_keys)
        for bucket, run in by_bucket(buckets[order]):
            mine = [words[i] for i in order[run]]
            yield bucket, len(mine), put_parts(*_pack_words(mine))

    def encode_words(blocks: list[bytes], ns: np.ndarray) -> list[bytes]:
        piece = _Encoders.get(pattern, shared)._encode_single_piece
        asked = [_unpack_words(*get_parts(b)) for b in blocks]
        distinct = {w: None for words in asked for w in words}
        for word in distinct:                       # each distinct word of the corpus once
            distinct[word] = piece(word)
        out = []
        for words in asked:
            found = [distinct[w] for w in words]
            sizes = np.fromiter(map(len, found), np.uint32, len(found))
            ids = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
            out.append(put_parts(put_ints(sizes), put_ints(ids)))
        return out

    def assemble(body: bytes, answers: dict[int, dict[int, bytes]]) -> pa.Table:
        ids, counts, codes, *words = get_parts(body)
        doc_ids, counts, codes = unpack_ids(ids), get_ints(counts, np.int64), get_ints(codes, np.uint32)
        words = _unpack_words(*words)
        buckets, order = _word_buckets(words, n_keys)
        sizes, flat = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for bucket, _ in by_bucket(buckets[order]):
            a, b = get_parts(answers[0][bucket])
            sizes.append(get_ints(a, np.uint32))
            flat.append(get_ints(b, np.uint32))
        at = np.empty(len(words), np.int64)
        at[order] = np.arange(len(words))
        sizes, flat = np.concatenate(sizes).astype(np.int64), np.concatenate(flat)
        starts = np.cumsum(sizes) - sizes
        out, first = [], 0
        for n in counts.tolist():                   # by position, one document at a time
            out.append(_gather(flat, starts, sizes, at[codes[first:first + n]])[0].astype("<u4").tobytes())
            first += n
        rows = {"doc_id": doc_ids, "ids": pa.array(out, pa.binary())}
        return pa.table({**rows, "decoded": _decoded(rows["ids"], shared)} if with_decoded else rows)

    answers = answer(chunks.ask(request), encode_words)
    return chunks.finish(answers, assemble, IDS_SCHEMA + ", decoded binary" * with_decoded)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """Adds (or replaces) ``decoded``: the bytes of the ids, from the token-byte table (id -> bytes)."""
    shared = _share(encoded.sparkSession, ranks)
    encoded = encoded.drop("decoded")
    names = encoded.columns
    schema = encoded.withColumn("decoded", F.lit(b"").cast("binary")).schema

    def decode_all(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _decoded(batch[ids_col], shared)],
                                             names=[*names, "decoded"])

    return encoded.mapInArrow(decode_all, schema)


def _decoded(ids: pa.Array, shared) -> pa.Array:
    data, starts, sizes = _token_bytes(shared)
    return pa.array([_gather(data, starts, sizes, np.frombuffer(x.as_py() or b"", "<u4").astype(np.int64))[0].tobytes()
                     for x in ids], pa.binary())


_TABLES: dict[int, tuple] = {}


def _token_bytes(shared):
    key = shared.value["key"]
    if key not in _TABLES:
        ranks = shared.value["ranks"]
        sizes = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        data = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
        _TABLES[key] = data, np.cumsum(sizes) - sizes, sizes
    return _TABLES[key]


def _gather(flat, starts, sizes, at):
    """The concatenation of flat[starts[i]:starts[i] + sizes[i]] for i in ``at``."""
    n = sizes[at]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total) + np.repeat(starts[at] - (ends - n), n)
    return flat[index], n


def _pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    return put_ints(np.fromiter(map(len, words), np.uint32, len(words))), squeeze(b"".join(words))


def _unpack_words(sizes: bytes, data: bytes) -> list[bytes]:
    data, ends = expand(data), np.cumsum(get_ints(sizes, np.uint32).astype(np.int64)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _word_buckets(words: list[bytes], n: int):
    keys = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    buckets = bucket_of(keys, n)
    return buckets, np.argsort(buckets, kind="stable")
