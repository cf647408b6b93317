"""N-gram Jaccard join by rare-first prefix filtering.

A document's set is its distinct n-word shingles. Two sets at the threshold share one of
their first few shingles in any fixed order; rare ones come first, so that few documents
share them. Rarity is a count over all documents in a sketch of fixed size; ties go by
the shingle's key.

Equal sets are one entity. Candidate pairs share a prefix shingle and pass the length
filter, the positional filter (what can still follow both positions) and, before the
sets are compared, the suffix filter (the sets' counts over 128 key ranges). A pair is
verified once, exactly.

Components need not verify all pairs of a large group of near copies. First every
prefix shingle's documents are compared with one of them, the hub that shares most; then
all remaining pairs of different components are candidates. No link between components
is lost, and pairs inside one are not needed.

Defined cases: null and empty texts have no set and link with nothing; shorter texts have
their whole sequence as one shingle; rows that share a doc_id are documents of their own;
a component is named by its least non-null doc_id (null if it has none, so that two can
have one name); a document without a set by its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfetch.llm.chunks import (ChunkTable, answer, bits, bucket_of, by_bucket, expand, from_bits, from_low_bytes,
                                 get_ints, get_parts, giving_back, low_bytes, put_ints, put_parts, small_batches, squeeze, stored)
from docfetch.llm.components import components
from docfetch.llm.native import join_documents
from docfetch.llm.words import shingle_sets

SLOTS_LOG = 18       # of the rarity sketch: 2**18 counters, whatever the corpus
RANGES_LOG = 7       # 128 key ranges of the suffix filter
MARKS_LOG = 22       # bits of the table of asked texts


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - SLOTS_LOG)).astype(np.int64)


def _rarity(docs: DataFrame, n: int) -> np.ndarray:
    """Shingle counts over all documents, by slot."""
    def count(batches):
        total = np.zeros(1 << SLOTS_LOG, np.int64)
        for batch in batches:
            for keys in shingle_sets(batch["text"], n):
                np.add.at(total, _slots(keys), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["slot", "n"])

    table = (docs.select("text").mapInArrow(giving_back(count), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
             .toArrow())                                            # 2**18 rows at most
    out = np.zeros(1 << SLOTS_LOG, np.int64)
    out[table["slot"].to_numpy()] = table["n"].to_numpy()
    return out


def _mark(text_key):
    return F.shiftrightunsigned(text_key, 64 - MARKS_LOG).cast("int")


def _digest(keys: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(keys.tobytes())


def groups(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id",
           text_col: str = "text", compression: str = "zstd") -> DataFrame:
    """Per document row: doc_id, text_key (xxhash64 of the text), n_shingles, component_id,
    ``n_copies``, the rows that have the same set, and ``group_key``, which tells components
    apart that have one name (null without a set). Linked: den * |A & B| >= num * |A | B|.
    ``compression`` is that of the tables written on the way, many of them small: uncompressed
    ones need some more disk, and no buffers of the codec outside of the executors' heap."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    rarity = spark.sparkContext.broadcast(_rarity(docs, n))

    def digests(batches):
        for batch in batches:
            keys = list(shingle_sets(batch["text"], n))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.array([len(k) for k in keys], pa.int32()),
                 pa.array([_digest(k) for k in keys], pa.binary())], names=["doc_id", "text_key", "n", "digest"])

    def prefixes(batches):
        for batch in batches:
            rows = []
            for keys in shingle_sets(batch["text"], n):
                size = len(keys)
                order = np.lexsort((keys, rarity.value[_slots(keys)]))
                ranges = np.bincount((keys >> np.uint64(64 - RANGES_LOG)).astype(np.int64), minlength=1 << RANGES_LOG)
                rows.append((size, _digest(keys), np.minimum(ranges, 255).astype(np.uint8).tobytes(),
                             low_bytes(keys[order[:size + (-num * size // den) + 1]], 8)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.array([r[0] for r in rows], pa.int32()),
                 *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))],
                names=["doc_id", "text_key", "n", "digest", "ranges", "prefix"])

    sets = stored(docs.mapInArrow(giving_back(digests), "doc_id long, text_key long, n int, digest binary"), "shingle_digests", compression)
    # one entity per distinct set, shown by one of its documents
    distinct = (docs.mapInArrow(giving_back(prefixes), "doc_id long, text_key long, n int, digest binary, ranges binary, prefix binary")
                .where("n > 0").groupBy("digest").agg(
                    F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"),
                    F.min_by(F.struct("doc_id", "text_key", "ranges", "prefix"), F.struct("doc_id", "text_key")).alias("shown"))
                .select("digest", "least_id", "n_copies", "n", "shown.doc_id", "shown.text_key", "shown.ranges",
                        "shown.prefix"))
    chunks, entities = _entities(distinct, compression)
    postings = _postings(chunks, compression)
    weight = postings.groupBy("entity").agg(F.count(F.lit(1)).alias("weight"))
    hubs = (postings.join(weight, "entity").groupBy("shingle")
            .agg(F.max_by(F.struct("entity", "n", "at"), F.struct("weight", -F.col("entity"))).alias("hub"))
            .select("shingle", F.col("hub.entity").alias("hub"), F.col("hub.n").alias("hub_n"),
                    F.col("hub.at").alias("hub_at")))
    need = lambda a, b: F.ceil(num * (F.col(a) + F.col(b)) / F.lit(num + den))

    def possible(na, ata, nb, atb):
        small, large = F.least(F.col(na), F.col(nb)), F.greatest(F.col(na), F.col(nb))
        rest = F.least(F.col(na) - F.col(ata), F.col(nb) - F.col(atb))
        return (small * den >= large * num) & (rest >= need(na, nb))

    pair = [F.least("entity", "hub").alias("a"), F.greatest("entity", "hub").alias("b")]
    compare = lambda pairs, name: stored(_verified(docs, entities, pairs, n, num, den, compression), name, compression)
    first = stored(postings.join(hubs, "shingle").where(F.col("entity") != F.col("hub"))
                   .where(possible("n", "at", "hub_n", "hub_at")).select(*pair).distinct(), "hub_pairs", compression)
    links = compare(first, "hub_links")

    # the remaining pairs: of different components, one of them outside the shingle's largest
    found = components(links, compression)
    labelled = (postings.join(found, F.col("entity") == F.col("node"), "left")
                .withColumn("component", F.coalesce("component", "entity")).drop("node"))
    main = (labelled.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("size"))
            .groupBy("shingle").agg(F.max_by("component", F.struct("size", "component")).alias("main"),
                                    F.count(F.lit(1)).alias("n_components"))
            .where("n_components > 1").drop("n_components"))
    mixed = stored(labelled.join(main, "shingle"), "mixed_postings", compression)
    outside = (mixed.where("component <> main")
               .select(F.col("shingle").alias("hub_shingle"), F.col("entity").alias("hub"), F.col("n").alias("hub_n"),
                       F.col("at").alias("hub_at"), F.col("component").alias("hub_component")))
    rest = (mixed.join(outside, (F.col("shingle") == F.col("hub_shingle"))
                       & (F.col("component") != F.col("hub_component"))
                       & ((F.col("component") == F.col("main")) | (F.col("entity") < F.col("hub")))
                       & possible("n", "at", "hub_n", "hub_at"))
            .select(*pair).distinct().join(first, ["a", "b"], "left_anti"))
    links = links.unionByName(compare(stored(rest, "rest_pairs", compression), "rest_links"))

    found = components(links, compression)
    labelled = (entities.select("entity", "digest", "least_id", "n_copies")
                .join(found, F.col("entity") == F.col("node"), "left")
                .withColumn("component", F.coalesce("component", "entity")).drop("node"))
    named = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_digest = (labelled.join(named, "component")
                 .select("digest", "n_copies", "component_id", F.col("component").alias("group_key")))
    return (sets.join(of_digest, "digest", "left")
            .select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"), "group_key"))


LIGHT = "entity long, digest binary, least_id long, n_copies long, n int, doc_id long, text_key long, ranges binary"


def _entities(distinct: DataFrame, compression: str) -> tuple[ChunkTable, DataFrame]:
    """The entities with their prefixes in chunks, where they get their numbers, and
    as a table without the prefixes."""
    columns = [c for c in distinct.columns if c != "prefix"]

    def pack(rows: pa.Array, prefix: pa.Array, chunk: int) -> bytes:
        if len(rows) >= 1 << 22 or chunk & 0xFFFFFFFF >= 1 << 20:
            raise ValueError("a chunk numbers 2**22 entities and a task 2**20 chunks")
        number = ((chunk >> 32) << 42) + ((chunk & 0xFFFFFFFF) << 22) + np.arange(len(rows))
        table = pa.table({"entity": pa.array(number), **{c: rows.field(c) for c in columns}})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        sizes = np.array([len(x.as_py()) for x in prefix], np.int64)
        return put_parts(squeeze(sink.getvalue().to_pybytes()), put_ints(sizes),
                         b"".join(x.as_py() for x in prefix))

    chunks = ChunkTable.build(distinct.select(F.struct(*columns).alias("doc_id"), F.col("prefix").alias("text")),
                              pack, with_chunk=True)

    def light(batches):
        for batch in batches:
            for body in batch["body"]:
                yield from _light(body.as_py()).select([c.split()[0] for c in LIGHT.split(", ")]).to_batches()

    return chunks, stored(chunks.df.mapInArrow(giving_back(light), LIGHT), "entities", compression)


def _light(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(expand(get_parts(body)[0])).read_all()


def _postings(chunks: ChunkTable, compression: str) -> DataFrame:
    """(entity, n, at, shingle) of the prefix shingles that two entities or more have."""
    n_keys = chunks.n_keys

    def keys_of(body: bytes) -> np.ndarray:
        return from_low_bytes(get_parts(body)[2], 8)

    def routes(keys: np.ndarray):
        buckets = bucket_of(keys, n_keys)
        order = np.argsort(buckets, kind="stable")
        for bucket, run in by_bucket(buckets[order]):
            yield bucket, order[run]

    def request(body: bytes):
        keys, counts = np.unique(keys_of(body), return_counts=True)
        for bucket, i in routes(keys):
            yield bucket, len(i), put_parts(low_bytes(keys[i], 6), bits(counts[i] > 1))

    def shared(blocks: list[bytes], ns: np.ndarray) -> list[bytes]:
        parts = [get_parts(b) for b in blocks]
        keys, inverse = np.unique(np.concatenate([from_low_bytes(p[0], 6) for p in parts]), return_inverse=True)
        many = np.concatenate([from_bits(p[1], n) for p, n in zip(parts, ns)])
        found = (np.bincount(inverse, weights=1 + many, minlength=len(keys)) > 1)[inverse]
        ends = np.cumsum(ns)
        return [bits(found[e - n:e]) for e, n in zip(ends.tolist(), ns.tolist())]

    def emit(body: bytes, answers) -> pa.Table:
        keys, inverse = np.unique(keys_of(body), return_inverse=True)
        found = np.zeros(len(keys), bool)
        for bucket, i in routes(keys):
            found[i] = from_bits(answers[0][bucket], len(i))
        table, sizes = _light(body), get_ints(get_parts(body)[1], np.int64) // 8
        at = np.arange(len(inverse)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept, of = found[inverse], np.repeat(np.arange(len(sizes)), sizes)
        return pa.table({"entity": table["entity"].take(of[kept]), "n": table["n"].take(of[kept]),
                         "at": pa.array(at[kept], pa.int32()), "shingle": pa.array(keys[inverse][kept].view(np.int64))})

    return stored(chunks.finish(answer(chunks.ask(request), shared), emit,
                                "entity long, n int, at int, shingle long"), "postings", compression)


def _verified(docs: DataFrame, entities: DataFrame, pairs: DataFrame, n: int, num: int, den: int,
              compression: str) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    spark = docs.sparkSession

    def joined(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        for x in ("a", "b"):
            side = table.select(F.col("entity").alias("of"), *(F.col(c).alias(f"{x}_{c}") for c in columns))
            pairs = pairs.join(side, F.col(x) == F.col("of")).drop("of")
        return pairs

    def suffix_filter(batches):
        """What the counts by key range leave of the overlap must still reach the threshold."""
        for batch in batches:
            counts = lambda c: np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(
                batch.num_rows, 1 << RANGES_LOG).astype(np.int16)
            size = batch["a_n"].to_numpy().astype(np.int64) + batch["b_n"].to_numpy()
            apart = np.abs(counts("a_ranges") - counts("b_ranges")).sum(axis=1, dtype=np.int64)
            kept = pa.array((size - apart) // 2 * (num + den) >= num * size)
            yield batch.select(["a", "b"]).filter(kept)

    close = stored(joined(pairs, entities, "n", "ranges").mapInArrow(giving_back(suffix_filter), "a long, b long"), "close_pairs", compression)
    asked = close.select(F.col("a").alias("entity")).unionByName(close.select(F.col("b").alias("entity"))).distinct()
    shown = entities.join(asked, "entity", "left_semi").select("entity", "doc_id", "text_key")
    # which texts are asked for, as a bit table of fixed size: the other texts, but for those
    # that share a bit, need no shuffle (a full table only filters less)
    marks = np.zeros(1 << MARKS_LOG, bool)
    marks[shown.select(_mark(F.col("text_key")).alias("mark")).distinct().toArrow()["mark"].to_numpy()] = True
    marked = spark.sparkContext.broadcast(marks)

    def pack(batches):
        for batch in batches:
            batch = batch.filter(pa.array(marked.value[batch["mark"].to_numpy()]))
            keys = list(shingle_sets(batch["text"], n))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.array([len(k) for k in keys], pa.int32()),
                 pa.array([low_bytes(k, 8) for k in keys], pa.binary())], names=["doc_id", "text_key", "size", "keys"])

    packed = (docs.where("text is not null").withColumn("mark", _mark(F.col("text_key")))
              .mapInArrow(giving_back(pack), "doc_id long, text_key long, size int, keys binary"))
    sets = stored(join_documents(packed, shown, "inner").select("entity", "size", "keys"), "asked_sets", compression)

    def check(batches):
        for batch in batches:
            columns = [batch[c] for c in ("a", "b", "a_size", "a_keys", "b_size", "b_keys")]
            rows = ([x.as_py() for x in row] for row in zip(*columns))
            kept = [(a, b) for a, b, *sides in rows if _linked(*sides, num, den)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.int64()),
                                              pa.array([x[1] for x in kept], pa.int64())], names=["a", "b"])

    return joined(close, sets, "size", "keys").mapInArrow(giving_back(check), "a long, b long").distinct()


def _linked(a_size, a_keys, b_size, b_keys, num, den) -> bool:
    both = len(np.intersect1d(from_low_bytes(a_keys, 8), from_low_bytes(b_keys, 8), assume_unique=True))
    return den * both >= num * (a_size + b_size - both)
