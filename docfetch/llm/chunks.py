"""Packed look-ups between the documents and a key space.

Several operators ask one question of every word or window of the corpus ("does
this occur anywhere else?", "how often?"). One row per occurrence costs a shuffle
many times the text, so the rows are packed:

* ``ChunkTable`` holds whole documents in chunks of a few MB, written once to the
  shared folder and bucketed by chunk id, so later passes read it without a shuffle;
* each chunk sends its *distinct* keys to key buckets, one binary block per bucket
  (a hot key leaves a chunk once, however often it occurs there);
* each key bucket answers every chunk with a block in the order of the request.

A chunk or a key bucket is what one task holds at a time. Chunks have a byte bound
(one longer document makes its own chunk); the number of key buckets grows with
the text (``BUCKET_TEXT`` bytes each).
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfetch.session import scratch_path

CHUNK_BYTES = 8 << 20
BUCKET_TEXT = 64 << 20
REQUEST = "bucket int, chunk long, n int, body binary"
ANSWER = "chunk long, bucket int, body binary"


# --- binary blocks -----------------------------------------------------------------

def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def put_ints(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, so that unused high bytes cost nothing."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return squeeze(np.ascontiguousarray(planes).tobytes())


def get_ints(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(expand(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def put_parts(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def get_parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at:at + 8], "little")
        out.append(data[at + 8:at + 8 + size])
        at += 8 + size
    return out


def low_bytes(keys: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each 64-bit key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def from_low_bytes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(bool)).tobytes()


def from_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


# --- hashing -----------------------------------------------------------------------

_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)
_BLOCK = 1 << 14     # keys worked on at a time, which stay in the processor's cache


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    out = np.array(h, np.uint64, ndmin=1)
    spare = np.empty(min(len(out), _BLOCK), np.uint64)
    for at in range(0, len(out), _BLOCK):
        mix_into(out[at:at + _BLOCK], spare)
    return out


def mix_into(h: np.ndarray, spare: np.ndarray) -> None:
    """``mix`` in place, of a block no longer than ``spare``."""
    shifted = spare[:len(h)]
    for _ in range(2):
        np.right_shift(h, _HALF, out=shifted)
        np.bitwise_xor(h, shifted, out=h)
        np.multiply(h, _MIX, out=h)
    np.right_shift(h, _HALF, out=shifted)
    np.bitwise_xor(h, shifted, out=h)


def mix_pairs(left: np.ndarray, right: np.ndarray, factor: np.uint64) -> np.ndarray:
    """``mix(mix(left) * factor + right)``, block by block."""
    out = np.array(left, np.uint64)
    right = np.broadcast_to(right, out.shape)
    spare = np.empty(min(len(out), _BLOCK), np.uint64)
    for at in range(0, len(out), _BLOCK):
        part = out[at:at + _BLOCK]
        mix_into(part, spare)
        np.multiply(part, factor, out=part)
        np.add(part, right[at:at + _BLOCK], out=part)
        mix_into(part, spare)
    return out


_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base modulo 2**64, and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        up[0] = down[0] = 1
        up[1:] = _BASE
        down[1:] = pow(_BASE, -1, 1 << 64)
        _POWERS["up"] = np.multiply.accumulate(up)
        _POWERS["down"] = np.multiply.accumulate(down)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums S with S[j] - S[i] the polynomial of values[i:j] (times base**i)."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((mix(keys + np.uint64(1)) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


# --- memory ------------------------------------------------------------------------

def give_back() -> None:
    """Freed memory of a Python worker back to the system. Workers are kept for later
    tasks, so what the allocators hold on to would add up over an executor's workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(fn: Callable) -> Callable:
    """A function for ``mapInArrow`` that gives memory back behind every batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told():
            for batch in batches:
                yield batch
                give_back()

        yield from fn(told())
        give_back()

    return run


# --- the chunk table ---------------------------------------------------------------

def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB (64 MB by default): a batch is held by the JVM and by
    the Python worker at once, several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") in ("64m", "67108864b", "67108864"):
        spark.conf.set(key, "8m")


class ChunkTable:
    """Documents in chunks, in the shared folder, bucketed by chunk id."""

    def __init__(self, spark: SparkSession, df: DataFrame, n_keys: int, n_chunk_buckets: int):
        self.spark, self.df, self.n_keys, self.n_chunk_buckets = spark, df, n_keys, n_chunk_buckets

    @classmethod
    def build(cls, docs: DataFrame, pack: Callable, chunk_bytes: int | None = None,
              with_chunk: bool = False) -> ChunkTable:
        """``docs`` has (doc_id, text); ``pack(doc_ids, texts)`` makes the chunk's body
        from the ids (nullable Arrow array) and texts (Arrow binary); ``with_chunk``
        also gives it the chunk's number."""
        spark, chunk_bytes = docs.sparkSession, chunk_bytes or CHUNK_BYTES
        small_batches(spark)

        def pack_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            at, held, size = TaskContext.get().partitionId() << 32, [], 0

            def flush():
                nonlocal at, held, size
                table = pa.Table.from_batches(held).combine_chunks()
                texts = _one(table["text"]).cast(pa.binary())
                body = pack(_one(table["doc_id"]), texts, *[at] * with_chunk)
                row = pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int64()), pa.array([size], pa.int64()), pa.array([body], pa.binary())],
                    names=["chunk", "n_bytes", "body"])
                at, held, size = at + 1, [], 0
                return row

            for batch in batches:
                lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch["text"]), 0), np.int64)
                start = 0
                ends = np.cumsum(lengths + 8)
                base = 0
                while start < batch.num_rows:
                    stop = int(np.searchsorted(ends, base + chunk_bytes - size, side="left")) + 1
                    stop = min(max(stop, start + 1), batch.num_rows)
                    held.append(batch.slice(start, stop - start))
                    size += int(ends[stop - 1] - base)
                    base, start = int(ends[stop - 1]), stop
                    if size >= chunk_bytes:
                        yield flush()
            if held:
                yield flush()

        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        path = scratch_path(spark, "chunks")
        name = f"docfetch_chunks_{uuid.uuid4().hex}"
        (docs.mapInArrow(giving_back(pack_all), "chunk long, n_bytes long, body binary")
         .write.bucketBy(buckets, "chunk").option("path", path).option("compression", "uncompressed")
         .saveAsTable(name))
        table = spark.table(name)
        total = table.agg(F.sum("n_bytes")).first()[0] or 0
        return cls(spark, table.select("chunk", "body"), max(buckets, -(-total // BUCKET_TEXT)), buckets)

    def ask(self, request: Callable) -> DataFrame:
        """``request(body)`` yields (bucket, n, block) for the chunk's distinct keys."""
        def ask_all(batches):
            for batch in batches:
                for chunk, body in zip(batch["chunk"], batch["body"]):
                    yield _request_rows(chunk.as_py(), request(body.as_py()))

        return self.df.mapInArrow(giving_back(ask_all), REQUEST)

    def ask_again(self, answers: DataFrame, request: Callable) -> DataFrame:
        """As ``ask``, with the answers so far: ``request(body, {kind: {bucket: block}})``."""
        def ask_one(left: pa.Table, right: pa.Table) -> pa.Table:
            body, chunk = left["body"][0].as_py(), left["chunk"][0].as_py()
            give_back()
            return pa.Table.from_batches([_request_rows(chunk, request(body, _by_kind(right)))])

        return (self.df.groupBy("chunk").cogroup(answers.where("chunk >= 0").groupBy("chunk"))
                .applyInArrow(ask_one, REQUEST))

    def finish(self, answers: DataFrame, result: Callable, schema: str) -> DataFrame:
        """``result(body, {kind: {bucket: block}})`` makes the rows (an Arrow table)."""
        def finish_one(left: pa.Table, right: pa.Table) -> pa.Table:
            give_back()
            return result(left["body"][0].as_py(), _by_kind(right))

        return (self.df.groupBy("chunk").cogroup(answers.where("chunk >= 0").groupBy("chunk"))
                .applyInArrow(finish_one, schema))


def _one(column: pa.ChunkedArray) -> pa.Array:
    array = column.combine_chunks()
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


def answer(requests: DataFrame, reply: Callable, kind: int = 0) -> DataFrame:
    """``reply(blocks, ns)`` gets the request blocks of one key bucket, in chunk order,
    and returns one block per request; an extra last block is kept as chunk -1."""
    def reply_all(table: pa.Table) -> pa.Table:
        give_back()
        table = table.sort_by("chunk")
        blocks = [x.as_py() for x in table["body"]]
        out = reply(blocks, table["n"].to_numpy())
        chunks = table["chunk"].to_pylist() + [-1] * (len(out) - len(blocks))
        return pa.table({"chunk": pa.array(chunks, pa.int64()),
                         "bucket": pa.array([table["bucket"][0].as_py()] * len(out), pa.int32()),
                         "body": pa.array(out, pa.binary()),
                         "kind": pa.array([kind] * len(out), pa.int32())})

    return requests.groupBy("bucket").applyInArrow(reply_all, ANSWER + ", kind int")


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The rows, written to the shared folder and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values in a sorted array."""
    if len(buckets):
        cuts = np.flatnonzero(np.diff(buckets)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(buckets)]):
            yield int(buckets[a]), slice(a, b)


def _request_rows(chunk: int, rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()),
         pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        names=["bucket", "chunk", "n", "body"])


def _by_kind(answers: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for kind, bucket, body in zip(*(answers[c].to_pylist() for c in ("kind", "bucket", "body"))):
        out.setdefault(kind, {})[bucket] = body
    return out


# --- documents inside a chunk ------------------------------------------------------

def pack_texts(doc_ids: pa.Array, texts: pa.Array) -> bytes:
    """Ids, lengths (-1: null) and the bytes of the texts."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(texts), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    data = b"".join(x.as_py() or b"" for x in texts)
    return put_parts(pack_ids(doc_ids), put_ints(lengths), squeeze(data))


def pack_ids(doc_ids: pa.Array) -> bytes:
    ids = pa.compute.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return put_parts(put_ints(ids), bits(doc_ids.is_null().to_numpy(zero_copy_only=False)))


def unpack_ids(data: bytes) -> pa.Array:
    ids, nulls = get_parts(data)
    ids = get_ints(ids, np.int64)
    return pa.array(ids, pa.int64(), mask=from_bits(nulls, len(ids)))


def order_of(doc_ids: pa.Array) -> np.ndarray:
    """Ids as integers in their order; a null id comes before all others."""
    return pa.compute.fill_null(doc_ids, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def unpack_texts(body: bytes) -> tuple[pa.Array, np.ndarray, bytes]:
    ids, lengths, data = get_parts(body)
    return unpack_ids(ids), get_ints(lengths, np.int64), expand(data)


def pieces(lengths: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``most`` bytes (at least one document each)."""
    start, size = 0, 0
    for i, n in enumerate(np.maximum(lengths, 0).tolist()):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def base_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): other columns, whatever their names, play no part."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
