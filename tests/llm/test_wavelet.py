"""Wavelet matrices: round trips, and queries against plain arrays."""

import datetime
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tideclock.llm import scratch, tokens, wavelet

UNTOUCHED = Tokenizer.from_file(tokens.default_tokenizer())


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 1), (1, 70000), (511, 3), (512, 2), (513, 9), (5000, 49408), (3000, 1)])
def test_shard_answers(n, top):
    rng = np.random.default_rng(n + top)
    ids = rng.integers(0, top, n).astype(np.uint32)
    lengths = [n // 2, n - n // 2]
    shard = wavelet.Shard(wavelet.build(ids, lengths, pa.array([7, None], pa.int64())))
    assert shard.ids().tolist() == ids.tolist()
    assert shard.lengths.tolist() == lengths and shard.keys.to_pylist() == [7, None]
    for at in rng.integers(0, n, 20).tolist() if n else []:
        assert shard.access(at) == ids[at]
        token = int(ids[at])
        assert shard.rank(token, at) == int((ids[:at] == token).sum())
        k = shard.rank(token, at)
        assert shard.select(token, k) == at
        assert shard.count(token) == int((ids == token).sum())
    assert shard.count(top + 5) == 0
    with pytest.raises(IndexError):
        shard.access(n)
    with pytest.raises(IndexError):
        shard.select(top + 5, 0)


def test_not_a_shard():
    with pytest.raises(ValueError):
        wavelet.Shard(b"something else, long enough")


def want(docs):
    out, start = [], 0
    for key, text in docs:
        ids = np.array([*UNTOUCHED.encode(text or "", add_special_tokens=False).ids, tokens.END_ID])
        out.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        start += len(ids)
    return out


def test_files_in_key_order(spark):
    rng = random.Random(2)
    docs = [(i * 3, " ".join(rng.choice(["red", "grün", "12%"]) for _ in range(rng.randint(0, 90)))) for i in range(200)]
    docs[5], docs[6] = (15, None), (18, "")
    frame = spark.createDataFrame([(*d, "k") for d in docs], "doc_id bigint, text string, key string").orderBy("text").repartition(3)
    shards = wavelet.write_shards(frame, scratch.new_path(spark, "test"), shard_tokens=500)
    assert shards.count() > 5
    assert sorted(tuple(r) for r in wavelet.document_digests(shards).collect()) == want(docs)


def test_empty_nulls_and_repeats(spark):
    kind = "doc_id bigint, text string"
    shards = wavelet.write_shards(spark.createDataFrame([], kind), scratch.new_path(spark, "test"))
    assert wavelet.document_digests(shards).count() == 0
    docs = [(None, "b"), (1, "a"), (1, "a"), (2, "c " * 9000)]
    shards = wavelet.write_shards(spark.createDataFrame(docs, kind), scratch.new_path(spark, "test"))
    assert sorted((tuple(r) for r in wavelet.document_digests(shards).collect()), key=lambda r: r[1]) == want(docs)


@pytest.mark.parametrize(("kind", "keys"), [("string", ["a", "b", "ü", None]), ("date", [datetime.date(2020, 1, 1), datetime.date(1900, 5, 5), None, datetime.date(2021, 1, 1)]), ("binary", [b"x", b"", b"\xff", None]), ("int", [3, 1, None, 2])])
def test_keys_of_other_types(spark, kind, keys):
    docs = [(k, f"text of {i} <|endoftext|>") for i, k in enumerate(keys)]
    shards = wavelet.write_shards(spark.createDataFrame(docs, f"doc_id {kind}, text string"), scratch.new_path(spark, "test"), shard_tokens=4)
    docs.sort(key=lambda d: (d[0] is not None, d[0]))
    plain = [(k if kind != "binary" or k is None else bytes(k), *rest) for k, *rest in sorted((tuple(r) for r in wavelet.document_digests(shards, kind).collect()), key=lambda r: r[1])]
    assert plain == want(docs)


def test_hot_key_is_dealt(spark):
    """A key with most of the rows does not end up in one part."""
    frame = spark.createDataFrame([(7 if i % 4 else i, f"text {i}") for i in range(4000)], "doc_id bigint, text string")
    shards = wavelet.write_shards(frame, scratch.new_path(spark, "test"))
    assert max(r["n_documents"] for r in shards.collect()) < 2000
    assert wavelet.document_digests(shards).count() == 4000


def test_registered_query(spark, data):
    from tideclock.llm.queries import QUERIES

    rows = sorted(tuple(r) for r in QUERIES["op6_token_shards"](spark, data).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    assert rows == want(docs)
