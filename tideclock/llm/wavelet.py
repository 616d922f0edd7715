"""Token ids as wavelet matrices, one compressed file per shard.

A shard maps its distinct ids to a dense alphabet and stores one bit-plane per
bit of it: at each level the tokens are parted, in order, by the bit, those
with 0 first. With the count of ones before every 512-bit block, a shard
answers which token is at a place (access), how often an id occurs before a
place (rank), and where its k-th occurrence is (select), without unpacking the
tokens.

File: the magic bytes, a length-prefixed JSON header, then one zstd frame with
alphabet, document lengths, document keys (an Arrow stream of one column, so
that keys of any type come back as they were), planes and block counts.
"""

from __future__ import annotations

from collections.abc import Iterator
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
import zstandard

from tideclock.llm import scratch, tokens

MAGIC = b"TIDEWM01"
BLOCK = 512
#: A shard closes with the document that brings it to so many tokens.
SHARD_TOKENS = 1 << 22


def _key_bytes(keys: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("key", keys.type)])) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays([keys], names=["key"]))
    return sink.getvalue().to_pybytes()


def build(ids: np.ndarray, lengths: list[int], keys: pa.Array) -> bytes:
    """The file of a shard: ``ids`` of its documents, one after the other."""
    alphabet, n = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, dtype=np.int64), len(ids)
    levels = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    dense = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, dtype=np.uint16 if levels <= 16 else np.uint32)
    dense[alphabet] = np.arange(len(alphabet))
    now = dense[ids]
    blocks, planes, counts, zeros = -(-n // BLOCK), [], [], []
    for level in range(levels):
        ones = (now & now.dtype.type(1 << (levels - 1 - level))) != 0
        packed = np.zeros(blocks * BLOCK // 8, dtype=np.uint8)
        bits = np.packbits(ones, bitorder="little")
        packed[: len(bits)] = bits
        planes.append(packed.tobytes())
        before = np.zeros(blocks + 1, dtype=np.uint32)
        np.cumsum(np.bitwise_count(packed.reshape(blocks, BLOCK // 8)).sum(axis=1, dtype=np.uint32), out=before[1:])
        counts.append(before.tobytes())
        zeros.append(n - int(before[-1]))
        if level + 1 < levels:
            now = np.concatenate([np.compress(~ones, now), np.compress(ones, now)])
    parts = [alphabet.astype("<u4").tobytes(), np.array(lengths, dtype="<u8").tobytes(), _key_bytes(keys), b"".join(planes), b"".join(counts)]
    header = json.dumps({"n": n, "levels": levels, "zeros": zeros, "sizes": [len(p) for p in parts]}).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


class Shard:
    """Reads a shard file."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a shard file")
        size = struct.unpack_from("<I", data, 8)[0]
        head = json.loads(data[12 : 12 + size])
        body, at, parts = memoryview(zstandard.ZstdDecompressor().decompress(data[12 + size :])), 0, []
        for part in head["sizes"]:
            parts.append(body[at : at + part])
            at += part
        self.n, self.levels, self.zeros = head["n"], head["levels"], head["zeros"]
        self.alphabet = np.frombuffer(parts[0], dtype="<u4")
        self.lengths = np.frombuffer(parts[1], dtype="<u8").astype(np.int64)
        self.keys = pa.ipc.open_stream(pa.py_buffer(parts[2])).read_all().column("key").combine_chunks()
        blocks = -(-self.n // BLOCK)
        self.planes = np.frombuffer(parts[3], dtype=np.uint8).reshape(self.levels, blocks * BLOCK // 8)
        self.before = np.frombuffer(parts[4], dtype=np.uint32).reshape(self.levels, blocks + 1)

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before a place."""
        block, rest = divmod(at, BLOCK)
        found = int(self.before[level, block])
        first = block * BLOCK // 8
        whole, bits = divmod(rest, 8)
        found += int(np.bitwise_count(self.planes[level, first : first + whole]).sum())
        if bits:
            found += (int(self.planes[level, first + whole]) & ((1 << bits) - 1)).bit_count()
        return found

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level, at >> 3]) >> (at & 7) & 1

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        symbol = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, at), self._ones(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            symbol = symbol << 1 | bit
        return int(self.alphabet[symbol])

    def _symbol(self, token: int) -> int | None:
        i = int(np.searchsorted(self.alphabet, token))
        return i if i < len(self.alphabet) and self.alphabet[i] == token else None

    def rank(self, token: int, at: int) -> int:
        """Occurrences of an id before a place."""
        symbol = self._symbol(token)
        if symbol is None:
            return 0
        low, high = 0, at
        for level in range(self.levels):
            a, b = self._ones(level, low), self._ones(level, high)
            if symbol >> (self.levels - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _place(self, level: int, bit: int, k: int) -> int:
        """Where a plane has its k-th (from 0) bit of that kind."""
        before = self.before[level].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        plane = np.unpackbits(self.planes[level, block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(plane == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """The place of an id's k-th occurrence, from 0."""
        symbol = self._symbol(token)
        if symbol is None or not 0 <= k < self.count(token):
            raise IndexError(k)
        start = 0
        for level in range(self.levels):
            a = self._ones(level, start)
            start = self.zeros[level] + a if symbol >> (self.levels - 1 - level) & 1 else start - a
        at = start + k
        for level in reversed(range(self.levels)):
            bit = symbol >> (self.levels - 1 - level) & 1
            at = self._place(level, bit, at - self.zeros[level] if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, dtype=kind)
        for level in reversed(range(self.levels)):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, dtype=kind)
            up[np.flatnonzero(~ones)] = now[: self.zeros[level]]
            up[np.flatnonzero(ones)] = now[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            now = up
        return self.alphabet[now] if self.levels else np.zeros(0, dtype="<u4")


FILES = "part int, shard int, tokens_before bigint, n_tokens bigint, n_documents bigint, content binary"


def _write(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        held, keys, size, kind = [], [], 0, None

        def close() -> pa.RecordBatch:
            content = build(np.concatenate(held), [len(x) for x in held], pa.array(keys, kind))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            row = [part, shard, before, size, len(keys), content]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["part", "shard", "tokens_before", "n_tokens", "n_documents", "content"])

        for batch in batches:
            kind = batch.column(0).type
            for key, ids in zip(batch.column(0).to_pylist(), tokens.documents(batch.column(1), path), strict=True):
                held.append(ids)
                keys.append(key)
                size += len(ids)
                if size >= limit:
                    yield close()
                    shard, before = shard + 1, before + size
                    held, keys, size = [], [], 0
        if keys:
            yield close()

    return run


def write_shards(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the ids of all documents in key order as shard files in ``folder``; the table of shards.

    Each Parquet file of the folder holds one shard file as ``content``, with
    its range part, its number there and the tokens of the part before it.
    Null keys come first. Rows with equal keys go by a hash of the text, so
    that a key with very many rows is dealt over several parts, then by text; a
    null text is an empty one. Keys may be of any type that can be ordered. An
    empty table gives no shards; other columns are not read.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    narrow = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = narrow.withColumn("th", F.xxhash64("text"))
    order = [F.col("key").asc_nulls_first(), F.col("th")]
    ordered = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    made = ordered.select("key", "text").mapInArrow(_write(tokenizer or tokens.default_tokenizer(), shard_tokens), FILES)
    made.write.options(compression="uncompressed", maxRecordsPerFile=1).parquet(folder)
    return spark.read.schema(made.schema).parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            shard = Shard(content.as_py())
            ids = shard.ids().astype("<u4")
            ends = np.cumsum(shard.lengths)
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - shard.lengths).tolist(), ends.tolist(), strict=True)]
            columns = [shard.keys, pa.array(start + ends - shard.lengths), pa.array(shard.lengths), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "n_tokens", "ids_crc32"])


def document_digests(shards: DataFrame, kind: str = "bigint") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, read back from the shard files.

    ``kind`` is the type of the keys that were written. No shards, no rows. ``start`` counts the ids of all documents before. The tokens of whole range
    parts, one number for each, are what is added up in one place.
    """
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    sums, at = {}, 0
    for row in totals.orderBy("part").collect():  # as many rows as there are range parts
        sums[row["part"]] = at
        at += row["n"]
    offset = F.create_map(*(F.lit(x) for pair in sums.items() for x in pair))[F.col("part")] if sums else F.lit(0)
    return shards.select((F.col("tokens_before") + offset).cast("long").alias("start"), "content").mapInArrow(_read, f"key {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
