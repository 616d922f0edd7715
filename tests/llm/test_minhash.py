"""Near-duplicates against all-pairs brute force."""

from collections import Counter
import random

import numpy as np
from pyspark.sql import functions as F
import pytest

from tideclock.llm import minhash

SCHEMA = "doc_id bigint, text string, component_id string, bucket string"


def sets(text, width):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not w:
        return set()
    n = min(width, len(w))
    return {(n, *w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, width, percent):
    found = {k: sets(t, width) for k, t in docs}
    top = {k: k for k in found}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    keys = sorted(found)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = found[a], found[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = root(a), root(b)
                top[max(ra, rb)] = min(ra, rb)
    return sorted((k, len(found[k]), root(k), root(k) == k) for k in keys)


def ours(spark, docs, width, percent):
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA).repartition(4)
    got = minhash.near_duplicates(frame, width=width, percent=percent).collect()
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got)


def corpus(seed, groups, per):
    """Groups of edited copies whose similarities lie on both sides of the threshold."""
    rng, docs = random.Random(seed), []
    words = [f"w{i}" for i in range(500)]
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 30, 120, 300]))]
        for _ in range(per):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy))
    docs += ["", None, " \t\n", "one", "ONE", "one two", "One  two", "two one", "É a b c", "é a b c", "x " * 2000]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("width", "percent", "groups", "per"), [(3, 85, 12, 6), (5, 80, 3, 30)])
def test_against_brute_force(spark, width, percent, groups, per):
    docs = corpus(width, groups, per)
    assert ours(spark, docs, width, percent) == brute(docs, width, percent)


def edited_copies(seed, n, length, edits):
    """Copies of one text, each with so many words changed."""
    rng = random.Random(seed)
    base, docs = [f"w{i}" for i in range(length)], []
    for i in range(n):
        copy = list(base)
        for at in rng.sample(range(length), edits):
            copy[at] = f"n{rng.randrange(10**9)}"
        docs.append((i, " ".join(copy)))
    return docs


def brute_large(docs, width, percent):
    """As brute, by one product of the matrix of shingles that two documents or more hold."""
    found = [sets(t, width) for _, t in docs]
    counts = Counter(x for s in found for x in s)
    number = {x: i for i, x in enumerate(x for x, n in counts.items() if n > 1)}
    held = np.zeros((len(docs), len(number)), dtype=np.float32)
    for row, s in enumerate(found):
        held[row, [number[x] for x in s if x in number]] = 1
    both, sizes = held @ held.T, np.array([len(s) for s in found])
    linked = 100 * both >= percent * (sizes[:, None] + sizes - both)
    top = np.full(len(docs), -1)
    for start in range(len(docs)):
        todo = [start] if top[start] < 0 else []
        while todo:
            x = todo.pop()
            top[x] = start
            new = np.flatnonzero(linked[x] & (top < 0))
            top[new] = start
            todo += new.tolist()
    return [(k, len(found[k]), int(top[k]), int(top[k]) == k) for k, _ in docs]


def test_large_group_just_under_the_threshold(spark):
    docs = edited_copies(1, 1500, 400, 7)
    want = brute_large(docs, 3, 85)
    assert brute_large(docs[:60], 3, 85) == brute(docs[:60], 3, 85)
    assert 1 < sum(r[3] for r in want) < 1500 and ours(spark, docs, 3, 85) == want


def test_large_group_in_several_blocks_and_by_bucket(spark, monkeypatch):
    docs = edited_copies(2, 200, 150, 3) + [(200 + i, t) for i, (_, t) in enumerate(edited_copies(3, 150, 90, 2))]
    want = brute_large(docs, 3, 85)
    monkeypatch.setattr(minhash, "BLOCK", 30)
    assert ours(spark, docs, 3, 85) == want
    by_bucket = lambda opened: opened.select(F.col("bucket").alias("unit"), "key", "n_shingles", "component").distinct()
    monkeypatch.setattr(minhash, "_units", lambda opened: minhash.scratch.materialize(by_bucket(opened), "units"))
    assert ours(spark, docs, 3, 85) == want


def test_family_near_the_threshold(spark):
    """3000 texts of 219 words, 200 of them common to all and 5 more to a pair: 0.88 within the 1500 pairs, 0.84 across."""
    common = [f"c{i}" for i in range(200)]
    docs = [(i, " ".join([*common, *(f"p{i // 2}-{j}" for j in range(5)), *(f"o{i}-{j}" for j in range(14))])) for i in range(3000)]
    sets = [set(minhash.shingles(docs[i][1].encode(), 3).tolist()) for i in range(3)]
    inside, across = len(sets[0] & sets[1]) / len(sets[0] | sets[1]), len(sets[0] & sets[2]) / len(sets[0] | sets[2])
    assert 0.85 < inside < 0.89 and 0.8 < across < 0.85
    got = {r[0]: r[2] for r in ours(spark, docs, 3, 85)}
    found = sum(got[2 * i + 1] == 2 * i for i in range(1500))
    print("recall", found / 1500)
    assert found >= 0.99 * 1500 and all(got[i] in (i, i - 1) for i in range(3000))


def test_columns_named_like_helpers(spark):
    frame = spark.createDataFrame([(1, "a b c", "x", "y"), (2, "a b c", "x", "y"), (None, "a b c", "x", "y"), (3, None, "x", "y")], "doc_id bigint, text string, gone_key string, component_id string")
    got = minhash.keep_one(frame)
    assert got.columns == frame.columns and sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 1, 3]


@pytest.mark.parametrize("hot", [0, 5, 10**9])
def test_hot_buckets_and_stars(spark, monkeypatch, hot):
    """The same result whether many keys are met by broadcast, few or none."""
    monkeypatch.setattr(minhash, "HOT", hot)
    docs = corpus(7, 4, 25) + [(10_000 + i, "a copy that many rows of the table hold " * 3) for i in range(60)]
    assert ours(spark, docs, 3, 85) == brute(docs, 3, 85)
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 130)] + [(39, 130)]
    got = minhash.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((x, 0) for x in {x for e in edges for x in e})


def test_rows_of_one_key(spark):
    """Rows of one key hold their texts together, be some of them empty, and repeated rows give a row each."""
    x, y, z = ("%s one two three four five six" % w for w in "xyz")
    rows = [(1, x), (2, x), (2, y), (2, None), (3, y), (3, y), (4, z), (4, ""), (5, ""), (5, None), (None, x), (None, None), (7, z), (7, y)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    want = [(k, 5 if t else 0, {5: 5, None: None}.get(k, 1), k in (None, 1, 5)) for k, t in rows]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_shared_counts():
    rng = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([rng.integers(0, 50, 30), rng.integers(0, 5000, n)]).astype(np.uint64)) for n in (0, 9, 700, 3000, 20) * 9]
    got = minhash.shared_counts(sets[:20], sets[20:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[20:]] for a in sets[:20]]
    assert not minhash.shared_counts([np.array([1], np.uint64)], [np.array([2], np.uint64)]).any()


def test_chain_of_copies_is_one_component(spark):
    words = [f"v{i}" for i in range(140)]
    docs = [(i, " ".join(words[2 * i : 2 * i + 80])) for i in range(25)]  # neighbours are similar, ends are not
    got = ours(spark, docs, 3, 85)
    assert got == brute(docs, 3, 85) and {r[2] for r in got} == {0}


def test_empty_repeated_and_null_keys(spark):
    assert ours(spark, [], 3, 85) == []
    frame = spark.createDataFrame([(None, "a b c", "", ""), (2, "a b c", "", ""), (2, "a b c", "", ""), (3, "A b c", "", "")], SCHEMA)
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame).collect())
    assert got == [("2", 2, True), ("2", 2, True), ("3", 2, False), ("None", None, True)]
    assert sorted(r["doc_id"] or 0 for r in minhash.keep_one(frame, width=3).collect()) == [0, 2, 2]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    b = np.unique(np.concatenate([a[:600], rng.integers(0, 2**63, 300).astype(np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(same - true) < 0.2
    assert (minhash.signature(a[::-1]) == minhash.signature(a)).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2060)]
    top = {x: x for e in edges for x in e}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    got = dict(tuple(r) for r in minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert all(got.get(x, x) == root(x) for x in top)
