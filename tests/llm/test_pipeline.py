"""Every stage of the pipeline against brute force on its own input."""

from collections import defaultdict
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from tests.llm import test_decontaminate as plain_search, test_line_dedup as plain_lines, test_minhash as plain_near, test_quality_rules as plain_rules
from tideclock.llm import decontaminate, quality_rules as Q, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, data):
    """(name, input rows, output rows) of each stage."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in P.STAGES:
        made = stage(spark, docs, data)
        if name != P.STAGES[-1][0]:
            assert made.columns == COLUMNS and made.dtypes == docs.dtypes
        rows = made.collect()
        out.append((name, [tuple(r) for r in docs.collect()], [tuple(r) for r in rows]))
        docs = spark.createDataFrame(rows, made.schema)
    return out


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    assert P.ORACLE_SQL is None


def test_quality_rules(stages):
    _, before, after = stages[0]
    hosts = defaultdict(list)
    fails = {}
    for d, text, _, source, _ in before:
        n_words, _, n_symbols, _, n_repeat = plain_rules.plain(text)
        fails[d] = n_words < 50 or 100 * n_repeat > 50 * n_words or 100 * n_symbols > Q.MAX_SYMBOL_PERCENT * n_words
        hosts[source].append(fails[d])
    rates = np.array([np.mean(x) for x in hosts.values()])
    m = min(max(rates.mean(), 1e-4), 1 - 1e-4)
    between = rates.var() - m * (1 - m) * np.mean([1 / len(x) for x in hosts.values()])
    weight = 1000 if between <= 0 else min(max(m * (1 - m) / between - 1, 1), 1000)
    bad = {h for h, x in hosts.items() if (sum(x) + m * weight) / (len(x) + weight) > Q.HOST_CUT}
    assert sorted(after) == sorted(r for r in before if not fails[r[0]] and r[3] not in bad)


def test_line_dedup(stages):
    _, before, after = stages[1]
    gone = {(d, no) for d, no, *_ in plain_lines.brute([r[:2] for r in before])}
    want = []
    for d, text, lang, source, n in before:
        lines = text.split("\n")
        kept = [x for i, x in enumerate(lines) if (d, i) not in gone]
        want.append((d, "\n".join(kept), lang, source, len("\n".join(kept)) if len(kept) < len(lines) else n))
    assert gone and sorted(after) == sorted(want)


def test_near_dedup(stages):
    _, before, after = stages[2]
    kept = {r[0] for r in plain_near.brute([r[:2] for r in before], 5, 80) if r[3]}
    assert sorted(after) == sorted(r for r in before if r[0] in kept)


def test_near_dedup_of_a_large_group(spark, data):
    docs = plain_near.edited_copies(1, 3000, 400, 6)
    want = [r[0] for r in plain_near.brute_large(docs, 5, 80) if r[3]]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars int").repartition(4)
    got = sorted(r["doc_id"] for r in P.near_dedup(spark, frame, data).select("doc_id").collect())
    assert (len(got), len(want)) == (263, 263) and got == want


def test_decontamination(stages, spark, data):
    _, before, after = stages[3]
    items = [tuple(r) for r in decontaminate.split_items(spark.read.parquet(f"{data}/benchmark.parquet")).collect()]
    index = decontaminate.Index(items)
    leaky = {r[0] for r in before if plain_search.brute(index, items, r[1])}
    assert leaky and sorted(after) == sorted(r for r in before if r[0] not in leaky)


def test_packing(stages):
    _, before, after = stages[4]
    want = {d: next(tokens.documents(pa.array([text], pa.string()), tokens.default_tokenizer())) for d, text, *_ in before}
    bins = defaultdict(list)
    for d, _, start, length, crc, sequence, offset in after:
        assert zlib.crc32(want[d][start : start + length].astype("<u4").tobytes()) == crc
        bins[sequence].append((offset, length))
    for placed in bins.values():
        ends = np.cumsum([n for _, n in sorted(placed)])
        assert [o for o, _ in sorted(placed)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert sum(r[3] for r in after) == sum(map(len, want.values()))


def test_empty_corpus(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, data)
    assert P.STAGES[-1][1](spark, docs, data).count() == 0


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns named like helpers."""
    prose = " ".join(f"word{i} and more{i * 7}" for i in range(60))
    rows = [(1, prose, "en", "a", len(prose)), (1, prose, "en", "a", len(prose)), (2, None, "en", "a", None), (3, "", "en", None, 0), (None, prose + " x", None, None, None), (None, None, None, None, None), (4, " ".join(f"w{i}" for i in range(150_000)), "fr", "b", 9), (5, "\n".join([prose, prose]), "en", "b", 1)]
    names = ("row", "m", "host", "failed", "gone_key", "gone_lines", "GONE_TH", "key", "shard", "part")
    kinds = "doc_id bigint, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(*r, *names) for r in rows], kinds).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_awkward_rows(spark, data, awkward, name):
    made = dict(P.STAGES)[name](spark, awkward, data)
    got = made.collect()
    if name == "best-fit packing":
        assert sum(r["length"] for r in got if r["doc_id"] is None) == 1 + len(next(tokens.documents(pa.array(["".join(r["text"] for r in awkward.collect() if r["doc_id"] is None and r["text"])]), tokens.default_tokenizer())))
        assert {r["doc_id"] for r in got} == {1, 2, 3, 4, 5, None}
        return
    assert made.columns == awkward.columns and made.dtypes == awkward.dtypes
    ids = sorted(str(r["doc_id"]) for r in got)
    assert all(r["row"] == "row" and r["GONE_TH"] == "GONE_TH" for r in got)
    if name == "quality rules":  # texts without words go; 5 has all its words twice
        assert ids == ["1", "1", "4", "None"]
    if name == "line dedup":
        texts = {(r["doc_id"], r["text"]) for r in got}
        assert len(ids) == 8 and (2, None) in texts and (None, None) in texts and (5, "") in texts
    if name == "MinHash near-dedup":  # the row without a key is linked with nothing
        assert ids == ["1", "1", "2", "3", "4", "None", "None"]
    if name == "benchmark decontamination":
        assert len(ids) == 8
