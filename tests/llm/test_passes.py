"""Work done once per chunk and one Python worker per task."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docfetch.llm import bpe, chunks, keys, suffix_buckets

RANKS = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257}
PATTERN = r"[^\s\p{L}\p{N}]+|\p{L}+|\p{N}+|\s+"
ROWS = [(1, "abc abcd abc"), (2, ""), (None, None), (2, "x 12 ab!"), (3, "ünï abab")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def test_runs_are_found_once_a_chunk(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (0, 150, 200, 900, 5000)] + [None, b"ab" * 700]
    packed = chunks.pack_texts(pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary()))
    body = suffix_buckets._Runs.pack(packed, 3)
    monkeypatch.setattr(suffix_buckets._Runs, "_runs", None)           # later passes only read them
    runs = suffix_buckets._Runs(body, 3)
    held = np.zeros(len(runs.data), int)
    for first, last in zip(runs.first, runs.last):
        held[first:last + 1] += 1
    starts = np.zeros(len(runs.data), int)
    for b, e in zip(runs.begin, runs.end):
        starts[b:max(b, e - 199)] = 1
    assert (held == starts).all()                                      # every string in one run


def test_block_wise_hashes():
    def mix(h):
        for _ in range(2):
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    rng = np.random.default_rng(5)
    for n in (0, 1, chunks._BLOCK, 3 * chunks._BLOCK + 7):
        a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for _ in range(2))
        assert (chunks.mix(a) == mix(a)).all() and (chunks.mix(a[::2]) == mix(a[::2])).all()
        assert (keys.combine(a, b) == mix(mix(a) * keys._FACTOR + b)).all()
        one = np.array([7], np.uint64)
        assert (keys.combine(a, one) == mix(mix(a) * keys._FACTOR + one)).all()


def test_decoding_takes_no_second_worker(docs):
    both = bpe.encode_and_decode(docs, RANKS, PATTERN)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1                                # the requests; none behind the assembly
    fields = ["doc_id", F.hex("ids"), F.hex("decoded")]
    got = sorted(map(str, both.select(*fields).collect()))
    apart = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS)
    assert got == sorted(map(str, apart.select(*fields).collect()))
    texts = both.select("doc_id", F.decode("decoded", "utf-8")).collect()
    assert sorted(map(tuple, texts), key=str) == sorted(((i, t or "") for i, t in ROWS), key=str)


def test_the_pipeline_holds_one_worker_a_core(spark, docs):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["encoding"](spark, docs, None)
    assert stage._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
