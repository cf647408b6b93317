"""Training-order materialisation: every fixed-length sequence gets a global slot.

Documents, in the order of their ids, are one stream of tokens with an end token after
each document; the stream is cut into sequences of ``length`` tokens. A keyed Feistel
network permutes the sequence numbers: it permutes a power of four not less than their
number, and results outside the range walk on along their cycle until they are inside. So
the slot of a sequence follows from the key and its number alone, and every slot is used
once.

Shards are consecutive ranges of slots. A shard is one block of ``shard_slots`` sequences
of equal stride, so a reader finds slot s at byte (s mod shard_slots) * stride of shard
s div shard_slots, reads on in training order, and resumes at any slot.

Defined cases: a null or empty text is its end token alone; null ids come first; rows that
share an id are ordered by their text's hash, equal rows in any order; the last sequence is
filled with end tokens; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfetch.llm.bpe import _Encoders, _share
from docfetch.llm.chunks import (ChunkTable, base_documents, get_ints, get_parts, mix, pack_ids, put_ints,
                                 put_parts, stored, unpack_ids)

ROUNDS = 6


def feistel(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The permutation of 0 .. n - 1, applied to some of them."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") for r in range(ROUNDS)]
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ np.uint64(k)) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]                      # cycle-walking
    return out.astype(np.int64)


def materialise(docs: DataFrame, ranks: dict[bytes, int], pattern: str, length: int = 512, key: int = 20240601,
                shard_slots: int = 4096, path: str | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Writes the shards (to ``path``, or the shared folder) and returns them as a table:
    (shard, first_slot, n_slots, stride, data). Token ids have the smallest unsigned type
    that holds them and the end token, whose id is the first free one."""
    spark = docs.sparkSession
    shared = _share(spark, ranks)
    end = max(ranks.values(), default=-1) + 1
    kind = np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")
    stride = length * kind.itemsize

    def pack(doc_ids: pa.Array, texts: pa.Array) -> bytes:
        encoder = _Encoders.get(pattern, shared)
        ids = [np.array([*encoder.encode_ordinary((t.as_py() or b"").decode()), end], kind) for t in texts]
        keys = [xxhash.xxh3_64_intdigest(t.as_py() or b"") for t in texts]
        return put_parts(pack_ids(doc_ids), put_ints(np.array(keys, np.uint64)),
                         put_ints(np.array([len(x) for x in ids], np.int64)), put_ints(np.concatenate(ids)))

    chunks = ChunkTable.build(base_documents(docs, id_col, text_col), pack)

    # where each document begins in the stream: sums inside ranges of ids, then over ranges
    def sizes(batches):
        for batch in batches:
            for chunk, body in zip(batch["chunk"].to_pylist(), batch["body"]):
                ids, keys, counts, _ = get_parts(body.as_py())
                counts = get_ints(counts, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(counts), chunk)), pa.array(np.arange(len(counts), dtype=np.int32)),
                     unpack_ids(ids), pa.array(get_ints(keys, np.int64)), pa.array(counts)],
                    names=["chunk", "place", "doc_id", "text_key", "n"])

    def running(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch["n"].to_numpy()
            ends = at + np.cumsum(n)
            at = int(ends[-1]) if len(ends) else at
            yield pa.RecordBatch.from_arrays([batch["chunk"], batch["place"], batch["n"], pa.array(ends - n, pa.int64()),
                                              pa.array(np.full(len(n), part), pa.int32())],
                                             names=["chunk", "place", "n", "inside", "part"])

    order = [F.col("doc_id").asc_nulls_first(), F.col("text_key"), F.col("chunk"), F.col("place")]
    offsets = stored(chunks.df.mapInArrow(sizes, "chunk long, place int, doc_id long, text_key long, n long")
                     .repartitionByRange(chunks.n_chunk_buckets, *order).sortWithinPartitions(*order)
                     .select("chunk", "place", "n")
                     .mapInArrow(running, "chunk long, place int, n long, inside long, part int"), "offsets")
    sums = sorted(tuple(r) for r in offsets.groupBy("part").agg(F.sum("n")).collect())   # a row a range
    before = dict(zip([p for p, _ in sums], np.cumsum([0] + [s for _, s in sums]).tolist()))
    total = sum(s for _, s in sums)
    n_sequences = -(-total // length)
    base = offsets.select("chunk", "place", (F.col("inside") + _lookup(F.col("part"), before)).alias("base"))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        """The documents of a chunk, cut where sequences end."""
        _, _, counts, ids = get_parts(left["body"][0].as_py())
        ids, counts = get_ints(ids, kind).tobytes(), get_ints(counts, np.int64)
        begin = right["base"].to_numpy()[np.argsort(right["place"].to_numpy())]
        firsts = (np.cumsum(counts) - counts).tolist()
        sequence, start, data = [], [], []
        for at, n, first in zip(begin.tolist(), counts.tolist(), firsts):
            edges = [at, *range(at - at % length + length, at + n, length), at + n]
            for a, b in zip(edges[:-1], edges[1:]):
                sequence.append(a // length)
                start.append(a % length)
                data.append(ids[(first + a - at) * kind.itemsize:(first + b - at) * kind.itemsize])
        slot = feistel(np.array(sequence, np.int64), n_sequences, key)
        return pa.table({"shard": pa.array(slot // shard_slots), "place": pa.array((slot % shard_slots).astype(np.int32)),
                         "start": pa.array(start, pa.int32()), "data": pa.array(data, pa.binary())})

    pieces = (chunks.df.groupBy("chunk").cogroup(base.groupBy("chunk"))
              .applyInArrow(cut, "shard long, place int, start int, data binary"))

    def fill(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        n = min(shard_slots, n_sequences - shard * shard_slots)
        block = np.full((n, length), end, kind)
        for place, start, data in zip(*(table[c].to_pylist() for c in ("place", "start", "data"))):
            block[place, start:start + len(data) // kind.itemsize] = np.frombuffer(data, kind)
        return pa.table({"shard": pa.array([shard], pa.int64()), "first_slot": pa.array([shard * shard_slots], pa.int64()),
                         "n_slots": pa.array([n], pa.int32()), "stride": pa.array([stride], pa.int32()),
                         "data": pa.array([block.tobytes()], pa.binary())})

    shards = (pieces.groupBy("shard")
              .applyInArrow(fill, "shard long, first_slot long, n_slots int, stride int, data binary"))
    if path is None:
        return stored(shards, "shards")
    shards.write.mode("errorifexists").parquet(path)
    return spark.read.schema(shards.schema).parquet(path)


def _lookup(part, before: dict[int, int]):
    """The tokens before each range: a literal map, one entry a shuffle partition."""
    if not before:
        return F.lit(0)
    return F.element_at(F.create_map(*(F.lit(x) for p, b in before.items() for x in (p, b))), part)


def read_slots(spark: SparkSession, shards: DataFrame, first: int, n: int, kind: str = "<u2") -> DataFrame:
    """Resumes at a slot: (slot, ids) of slots first .. first + n - 1; other shards are
    not read."""
    def cut(batches):
        for batch in batches:
            for base, size, stride, data in zip(*(batch[c].to_pylist() for c in ("first_slot", "n_slots", "stride", "data"))):
                slots = range(max(first, base), min(first + n, base + size))
                rows = [np.frombuffer(data, kind, stride // np.dtype(kind).itemsize, (s - base) * stride).astype(np.int32)
                        for s in slots]
                yield pa.RecordBatch.from_arrays([pa.array(list(slots), pa.int64()),
                                                  pa.array([r.tolist() for r in rows], pa.list_(pa.int32()))],
                                                 names=["slot", "ids"])

    return (shards.where((F.col("first_slot") < first + n) & (F.col("first_slot") + F.col("n_slots") > first))
            .mapInArrow(cut, "slot long, ids array<int>"))


def slots(shards: DataFrame) -> DataFrame:
    """(slot, shard, byte_offset, sequence_sha256) of every slot."""
    def hashes(batches):
        for batch in batches:
            for shard, base, size, stride, data in zip(*(batch[c].to_pylist() for c in
                                                         ("shard", "first_slot", "n_slots", "stride", "data"))):
                view = memoryview(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(base, base + size)), pa.array(np.full(size, shard)),
                     pa.array(np.arange(size, dtype=np.int64) * stride),
                     pa.array([hashlib.sha256(view[i * stride:(i + 1) * stride]).hexdigest() for i in range(size)])],
                    names=["slot", "shard", "byte_offset", "sequence_sha256"])

    return shards.mapInArrow(hashes, "slot long, shard long, byte_offset long, sequence_sha256 string")
