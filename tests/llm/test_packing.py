"""Packing: every token once, no gaps, and few sequences."""

from collections import defaultdict
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tideclock.llm import packing, tokens

SCHEMA = "doc_id bigint, text string, ids string, offset string"
PATH = tokens.default_tokenizer()
UNTOUCHED = Tokenizer.from_file(PATH)


def check(rows, docs, size):
    """The documents' ids come out whole; sequences are gapless and not over-long; only long documents are cut."""
    want = {k: [x.ids for x in UNTOUCHED.encode_batch([t or ""], add_special_tokens=False)][0] + [1] for k, t in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for key, got in pieces.items():
        got.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(len(got)))
        assert [r["start"] for r in got] == [i * size for i in range(len(got))]
        assert all(r["length"] == size for r in got[:-1]) and got[-1]["length"] <= size
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got]).tolist() == want[key]
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences), sum(map(len, want.values()))


def test_documents_survive_packing(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["the", "house,", "écrit", "zzxq", "12"]) for _ in range(rng.choice([0, 1, 3, 20, 200, 700])))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "   "), (303, "a " * 5000), (304, "a <|endoftext|> b"), (305, "<|startoftext|>" * 40)]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA).repartition(5)
    rows = packing.pack(frame, size=256, open_bins=8).collect()
    made, total = check(rows, docs, 256)
    assert made <= 1.03 * total / 256 + 1


def test_empty_table_and_null_keys(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, "a b", "x", "y"), (None, "a b", "x", "y")], SCHEMA)).collect()
    assert [(r["doc_id"], r["length"]) for r in rows] == [(None, 3), (None, 3)]
    assert sorted(r["offset"] for r in rows) == [0, 3]


@pytest.mark.parametrize("open_bins", [1, 3, 64])
def test_packer_is_best_fit(open_bins):
    rng, size = random.Random(open_bins), 50
    lengths = [rng.randint(1, size) for _ in range(2000)]
    packer, bins, closed, expected = packing.Packer(size, open_bins), [], [], []
    for i, n in enumerate(lengths):
        closed += packer.add(i, n)
        fits = [b for b in bins if size - b[0] >= n]
        if fits:
            chosen = max(fits, key=lambda b: b[0])
            least = [b for b in fits if b[0] == chosen[0]]
            chosen = max(least, key=lambda b: b[2])  # the one last put there
        else:
            chosen = [0, [], 0]
            bins.append(chosen)
        chosen[0] += n
        chosen[1].append(i)
        chosen[2] = i
        if chosen[0] == size:
            bins.remove(chosen)
            expected.append(chosen)
        elif len(bins) > open_bins:
            fullest = max(bins, key=lambda b: (b[0], b[2]))
            bins.remove(fullest)
            expected.append(fullest)
    closed += packer.rest()
    expected += bins
    assert sorted([i for i, _ in b[2]] for b in closed) == sorted(b[1] for b in expected)
    assert packer.rest() == []


def test_many_small_partitions_cost_little(spark):
    rng = random.Random(3)
    docs = [(i, "a " * rng.randint(0, 120)) for i in range(600)]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA).repartition(60)
    made, total = check(packing.pack(frame, size=128).collect(), docs, 128)
    assert made <= 1.03 * total / 128 + 1


def test_second_round_keeps_its_bound(spark, monkeypatch):
    """The pieces of the second round meet no more open bins than those of the first."""
    most = []
    add = packing.Packer.add
    monkeypatch.setattr(packing.Packer, "add", lambda self, *a: (add(self, *a), most.append(self.count))[0])
    rows = [(0, 0, 0, n, bytes(4 * n)) for n in (random.Random(8).randint(1, 60) for _ in range(500))]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "piece", "start", "length", "ids"])
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    placed = [r for b in packing._second_round(64, 8)(iter([batch])) for r in b.to_pylist()]
    assert len(placed) == 500 and max(most) == 8


def test_registered_query(spark, data):
    from tideclock.llm.queries import QUERIES

    rows = QUERIES["op1_best_fit_packing"](spark, data).collect()
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: np.array([*UNTOUCHED.encode(r["text"] or "", add_special_tokens=False).ids, tokens.END_ID]) for r in texts}
    for r in rows:
        piece = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(piece.astype("<u4").tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in rows) == sum(map(len, want.values()))
