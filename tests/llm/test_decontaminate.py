"""The BM25 search against scoring every item on every passage."""

import random

import numpy as np

from tideclock.llm import decontaminate as D

SCHEMA = "doc_id bigint, text string, item_id string, score string"


def brute(index, items, text):
    """All items scored on all passages, without bounds."""
    of, out = D.words(text), {}
    made = [(i, D.words(q), D.words(a)) for i, q, a in items if D.words(q) or D.words(a)]
    n = len(made)
    frequency = {}
    for _, q, a in made:
        for w in set(q + a):
            frequency[w] = frequency.get(w, 0) + 1
    mean = sum(len(q + a) for _, q, a in made) / n
    last = max(0, (len(of) - 1) // index.half - 1)
    for p in range(last + 1):
        run = of[p * index.half : (p + 2) * index.half]
        for item, q, a in made:
            words = q + a
            weight = {w: np.log1p((n - frequency[w] + 0.5) / (frequency[w] + 0.5)) * (tf := words.count(w)) * (D.K1 + 1) / (tf + D.K1 * (1 - D.B + D.B * len(words) / mean)) for w in set(words)}
            score = sum(weight[w] for w in set(run) & set(weight)) / sum(weight.values())
            if score < D.THRESHOLD:
                continue

            def share(part, run=run):
                want = D.shingles(part)
                k = min(D.WIDTH, len(part))
                have = {b" ".join(run[i : i + k]) for i in range(len(run) - k + 1)}
                return len(want & have) / len(want) if want else 0.0

            if (q and share(q) >= D.OVERLAP) or (a and share(a) >= D.OVERLAP and (not q or len(a) >= D.TELLING)):
                old = out.get(item, (0, 0, 0))
                best = tuple(max(x, y) for x, y in zip(old, (score, share(q), share(a)), strict=False))
                has_q, has_a = not q or best[1] >= D.OVERLAP, not a or best[2] >= D.OVERLAP
                out[item] = (*best, "whole" if has_q and has_a else "question" if has_q else "answer")
    return out


def world(seed):
    rng = random.Random(seed)
    words = ["the", "of", "and"] * 20 + [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([2, 6, 20, 50]))), rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.choice([4, 12])))])) for i in range(40)]
    items += [(90, None, "only an answer that is long enough"), (91, "", None)]
    docs = []
    for _ in range(60):
        of = [rng.choice(words) for _ in range(rng.choice([0, 5, 70, 300]))]
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)
            part = ((item[1] or "") + " " + (item[2] or "")).split()
            part = part[: rng.randint(len(part) // 3, len(part))]
            at = rng.randrange(len(of) + 1)
            of[at:at] = [w.upper() + "," if rng.random() < 0.3 else w for w in part]
        docs.append(" ".join(of))
    return items, docs


def test_bounds_lose_nothing():
    for seed in range(4):
        items, docs = world(seed)
        index = D.Index(items)
        kinds = set()
        for text, got in zip(docs, index.search([text.encode() for text in docs]), strict=True):
            want = brute(index, items, text)
            assert got.keys() == want.keys()
            assert all(np.allclose(got[k][:3], want[k][:3]) and got[k][3] == want[k][3] for k in got)
            kinds |= {(k, x[3]) for k, x in got.items()}
        assert len(kinds) > 15


def test_pivots_pass_blocks_over(monkeypatch):
    """More items than blocks, and terms of every frequency: the same hits as without any bound, in batches of any size."""
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6)) % 4000}" for _ in range(40000)]
    items = [(i, " ".join(rng.sample(words, rng.randint(8, 60))), None) for i in range(300)]
    docs = []
    for _ in range(40):
        of = rng.sample(words, rng.randint(50, 500))
        part = rng.choice(items)[1].split()
        of[20:20] = part[: rng.randint(2, len(part))]
        docs.append(" ".join(of).encode())
    index = D.Index(items)
    got = index.search(docs)
    assert [{k: x[3] for k, x in g.items()} for g in got] == [{k: x[3] for k, x in brute(index, items, t.decode()).items()} for t in docs]
    assert sum(map(len, got)) > 10
    monkeypatch.setattr(D, "BATCH", 7)
    assert index.search(docs) == got
    scored = []
    true = np.bincount
    monkeypatch.setattr(D.np, "bincount", lambda *a, **k: scored.append(len(a[0])) or true(*a, **k))
    low = sorted(index.terms, key=lambda w: index.most[index.terms[w]])[:3]
    assert sum(index.most[index.terms[w]] for w in low) < D.THRESHOLD
    assert index.search([b" ".join(low)]) == [{}] and sum(scored) == 0  # no pivot: nothing is looked at


def test_parts_told_apart():
    question, answer = "which of these rivers is the longest one of all the rivers", "the river that flows through the nine countries of the east"
    index = D.Index([(1, question, answer), (2, "quite other words in this item here", "short")])
    found = index.search([f"x {question} y {answer} z".encode(), f"x {question} y".encode(), f"x {answer} y".encode(), b"x short y"])
    assert [{k: v[3] for k, v in f.items()} for f in found] == [{1: "whole"}, {1: "question"}, {1: "answer"}, {}]


def test_very_long_text():
    item = " ".join(f"q{i}" for i in range(60))
    index = D.Index([(1, item, None), (2, "other words", None)])
    text = " ".join(["q1 x q2 y"] * 200_000 + [item] + ["z"] * 1000)
    assert index.search([text.encode(), None, b""])[0][1][3] == "whole"


def test_every_run_lies_within_a_passage():
    item = " ".join(f"q{i}" for i in range(60))
    index = D.Index([(1, item, None), (2, "other words", None)])
    for at in range(0, 200, 7):
        text = " ".join(["x"] * at + item.split() + ["y"] * 100)
        assert index.search([text.encode()])[0][1][1] == 1.0


def test_operator(spark, monkeypatch):
    items, docs = world(9)
    frame = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(docs)] + [(None, docs[0], "a", "b"), (7, None, "a", "b"), (8, "", "a", "b")], SCHEMA).repartition(3)
    table = spark.createDataFrame(items, "item_id bigint, question string, answer string")
    index = D.Index(items)
    want = sorted((str(i), k) for i, t in [*enumerate(docs), (None, docs[0])] for k in index.search([t.encode()])[0])
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in D.leaks(frame, table).collect()) == want
    stay = D.clean(frame, table)
    assert stay.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in stay.collect()) == sorted([str(i) for i, t in enumerate(docs) if not index.search([t.encode()])[0]] + ["7", "8"] + ["None"] * (not index.search([docs[0].encode()])[0]))
    assert D.leaks(frame, table.limit(0)).count() == 0 and D.clean(frame, table.limit(0)).count() == frame.count()
    assert D.leaks(frame.limit(0), table).count() == 0
    monkeypatch.setattr(D, "SHARD_BYTES", 3000)  # several indexes
    whole = [(str(i), items[3][0]) for i in [500]]
    one = spark.createDataFrame([(500, items[3][1] + " " + (items[3][2] or ""), "a", "b")], SCHEMA)
    assert set(whole) <= {(str(r["doc_id"]), r["item_id"]) for r in D.leaks(one, table).collect()}


def test_several_indexes_score_as_one(spark, monkeypatch):
    items, docs = world(11)
    frame = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(docs)], SCHEMA)
    table = spark.createDataFrame(items, "item_id bigint, question string, answer string")
    index = D.Index(items)
    want = sorted((i, k, *facts) for i, t in enumerate(docs) for k, facts in index.search([t.encode()])[0].items())
    monkeypatch.setattr(D, "SHARD_BYTES", 3000)
    got = sorted(tuple(r) for r in D.leaks(frame, table).collect())
    assert len(want) > 20 and [(*r[:2], r[5]) for r in got] == [(*r[:2], r[5]) for r in want] and np.allclose([r[2:5] for r in got], [r[2:5] for r in want])
    leaky = {r[0] for r in want}
    assert sorted(r["doc_id"] for r in D.clean(frame, table).collect()) == [i for i in range(len(docs)) if i not in leaky]


def test_items_without_id(spark):
    text = "a question that has no number but words enough"
    table = spark.createDataFrame([(None, text, None), (None, None, None), (1, "quite another thing to ask", "yes")], "item_id bigint, question string, answer string")
    frame = spark.createDataFrame([(1, f"before {text} after", "a", "b"), (2, "nothing of that", "a", "b")], SCHEMA)
    assert [(r["doc_id"], r["item_id"]) for r in D.leaks(frame, table).collect()] == [(1, None)]
    assert [r["doc_id"] for r in D.clean(frame, table).collect()] == [2]


def test_split_items(spark):
    got = D.split_items(spark.createDataFrame([(1, "What is it? It is this."), (2, "One sentence."), (3, ""), (4, None)], "item_id bigint, text string"))
    assert [tuple(r) for r in got.orderBy("item_id").collect()] == [(1, "What is it?", "It is this."), (2, "One sentence.", None), (3, "", None), (4, None, None)]
