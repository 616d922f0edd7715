"""Bounded-space online best-fit packing of documents into training sequences.

A packer holds a fixed number of open bins, keyed by free space in a bitset. A
piece goes to the open bin that it fills best; if none has room a bin is
opened, and if too many are open the fullest closes. Packing runs where the
documents are tokenized. The bins still open at the end of a partition are
taken apart and their pieces go through a second packer of the same bound that
serves many partitions, so that what stays half full does not grow with their
number. It looks ahead over a fixed number of pieces and takes the longest of
them first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tideclock.llm import scratch, tokens

MAX_TOKENS = 4096
OPEN_BINS = 256
#: Bins left open whose pieces one task of the second round takes.
SECOND_ROUND_BINS = 4096
#: Pieces that the second round looks ahead.
AHEAD = 1024

PIECE = "key {key}, piece int, start bigint, length bigint, ids binary"
PLACED = PIECE + ", sequence_id bigint, offset bigint, closed boolean"


class Packer:
    """Best fit over at most ``open_bins`` open bins of ``size`` tokens."""

    def __init__(self, size: int = MAX_TOKENS, open_bins: int = OPEN_BINS) -> None:
        self.size, self.open_bins = size, open_bins
        self.free = 0  # bit f: some open bin has f tokens of free space
        self.bins: dict[int, list[list]] = {}  # by free space; a bin is [number, used, items]
        self.count = self.made = 0

    def _take(self, free: int) -> list:
        stack = self.bins[free]
        chosen = stack.pop()
        if not stack:
            del self.bins[free]
            self.free ^= 1 << free
        self.count -= 1
        return chosen

    def _put(self, chosen: list) -> None:
        free = self.size - chosen[1]
        self.bins.setdefault(free, []).append(chosen)
        self.free |= 1 << free
        self.count += 1

    def add(self, item: object, length: int) -> list[list]:
        """Place an item of 1 to ``size`` tokens; the bins that close now."""
        fits = self.free >> length
        if fits:
            chosen = self._take(length + (fits & -fits).bit_length() - 1)
        else:
            chosen = [self.made, 0, []]
            self.made += 1
        chosen[2].append((item, chosen[1]))
        chosen[1] += length
        if chosen[1] == self.size:
            return [chosen]
        self._put(chosen)
        if self.count > self.open_bins:
            return [self._take((self.free & -self.free).bit_length() - 1)]
        return []

    def rest(self) -> list[list]:
        """The bins that are still open, by number."""
        left = sorted((b for stack in self.bins.values() for b in stack), key=lambda b: b[0])
        self.free, self.bins, self.count = 0, {}, 0
        return left


class _Rows:
    """Gathers placed pieces into record batches of about 4 MB."""

    def __init__(self, schema: pa.Schema, base: int) -> None:
        self.schema, self.base, self.rows, self.held = schema, base, [], 0

    def add(self, bins: list[list], closed: bool) -> Iterator[pa.RecordBatch]:
        for number, _, items in bins:
            for item, offset in items:
                self.rows.append((*item, self.base + number, offset, closed))
                self.held += len(item[4])
            if self.held > 1 << 22:
                yield self.flush()

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(self.schema)
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def _schema(key: pa.DataType) -> pa.Schema:
    return pa.schema([("key", key), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("closed", pa.bool_())])


def _first_round(path: str, size: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, rows = Packer(size, open_bins), None
        for batch in batches:
            rows = rows or _Rows(_schema(batch.column(0).type), TaskContext.get().partitionId() << 32)
            for key, ids in zip(batch.column(0).to_pylist(), tokens.documents(batch.column(1), path), strict=True):
                data = ids.astype("<u4").tobytes()
                for piece, start in enumerate(range(0, len(ids), size)):
                    length = min(size, len(ids) - start)
                    yield from rows.add(packer.add((key, piece, start, length, data[4 * start : 4 * (start + length)]), length), True)
        if rows:
            yield from rows.add(packer.rest(), False)
            yield rows.flush()

    return run


def _second_round(size: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, rows, waiting = Packer(size, open_bins), None, []

        def place() -> Iterator[pa.RecordBatch]:
            waiting.sort(key=lambda item: -item[3])
            for item in waiting:
                yield from rows.add(packer.add(item, item[3]), True)
            waiting.clear()

        for batch in batches:
            rows = rows or _Rows(_schema(batch.column(0).type), (1 << 62) + (TaskContext.get().partitionId() << 32))
            for item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.append(item)
                if len(waiting) == AHEAD:
                    yield from place()
        if rows:
            yield from place()
            yield from rows.add(packer.rest(), True)
            yield rows.flush()

    return run


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, size: int = MAX_TOKENS, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: key, piece, start, length, ids, sequence_id, offset.

    ``ids`` holds the piece's tokens as little-endian unsigned 32-bit numbers.
    A document is its text's ids and the end id; null and empty texts are the
    end id alone. Only documents of over ``size`` tokens are cut. Pieces of a
    sequence follow each other from offset 0 without gaps. Null keys and
    repeated rows are packed like others; an empty table gives no rows; other
    columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    scratch.small_batches(spark)
    kind = dict(docs.dtypes)[key]
    narrow = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    first = narrow.mapInArrow(_first_round(tokenizer or tokens.default_tokenizer(), size, open_bins), PLACED.format(key=kind))
    path = scratch.new_path(spark, "packed")
    first.write.option("compression", "zstd").partitionBy("closed").parquet(path)
    placed = spark.read.schema(first.schema).option("basePath", path).parquet(path)
    open_rows = placed.filter(~F.col("closed")).drop("closed")
    tasks = 1 + open_rows.agg(F.countDistinct("sequence_id")).first()[0] // SECOND_ROUND_BINS
    # By hash: an order that is the same in every attempt of a task and mixes long pieces with short ones.
    again = open_rows.drop("sequence_id", "offset").coalesce(tasks).sortWithinPartitions(F.xxhash64("key", "piece", "ids"))
    second = again.mapInArrow(_second_round(size, open_bins), PLACED.format(key=kind))
    return placed.filter(F.col("closed")).unionByName(second).drop("closed").withColumnRenamed("key", key)
