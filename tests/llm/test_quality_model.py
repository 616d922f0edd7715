"""The classifier: its risk, its folds and its accuracy on held-out labels."""

import zlib

import numpy as np

from tideclock.llm import quality_model as M


def test_features_of_odd_texts():
    for text in (None, b"", b"   ", b"a", b"!!!", "é".encode() * 10_000, b"x " * 50_000):
        got = M.features(text)
        assert len(got) == len(M.FEATURES) and np.isfinite(got).all()
    junk, prose = b"AB!! CD!! EF!! " * 20, b"the cat sat on a mat and then it left. " * 2
    assert M.features(junk)[M.FEATURES.index("capitals")] == 1 and M.features(prose)[M.FEATURES.index("capitals")] == 0


def test_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    k = len(M.FEATURES)
    good, bad = rng.normal(1, 1, (3000, k)), rng.normal(-1, 1, (1000, k))
    model = M.fit_nnpu(good[:1000], np.concatenate([good[1000:], bad]), 2 / 3)
    score = lambda x: 1 / (1 + np.exp(-(x @ np.array(model.weights) + model.bias)))
    assert (score(good) > 0.5).mean() > 0.97 and (score(bad) < 0.5).mean() > 0.97


def test_risk_stays_honest_on_noise():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (400, len(M.FEATURES)))
    model = M.fit_nnpu(x[:60], x[60:], 0.5)
    z = x @ np.array(model.weights) + model.bias
    assert np.abs(z).mean() < 6  # unbounded without the bound at zero


def test_prior_from_the_mixture():
    """The share of positives among unlabelled rows is found without a negative label."""
    rng = np.random.default_rng(2)
    k = len(M.FEATURES)
    for share in (0.3, 0.6, 0.9):
        n = 8000
        good, bad = rng.normal(1, 1, (int(n * share) + 2000, k)), rng.normal(-1, 1, (int(n * (1 - share)), k))
        model = M.fit_nnpu(good[:2000], np.concatenate([good[2000:], bad]))
        assert abs(model.prior - share) < 0.06


def test_rows_in_the_cluster_fit_as_arrays(spark):
    rng = np.random.default_rng(6)
    k = len(M.FEATURES)
    x = np.concatenate([rng.normal(1, 1, (900, k)), rng.normal(-1, 1, (300, k))])
    y = np.arange(1200) < 400
    frame = spark.createDataFrame([(a.tolist(), bool(b)) for a, b in zip(x, y, strict=True)], "x array<double>, positive boolean").repartition(5)
    got, want = M.fit_rows(frame), M.fit_nnpu(x[y], x)
    assert np.isclose(got.prior, want.prior) and np.allclose(got.weights, want.weights, atol=1e-4) and np.isclose(got.bias, want.bias, atol=1e-4)


def test_folds_agree(spark):
    rows = [(i,) for i in [0, 1, 7, 12345678901, -3]]
    got = spark.createDataFrame(rows, "k bigint").select("k", M.fold(M.F.col("k")).alias("f")).collect()
    assert all(r["f"] == M.fold_of(r["k"]) == zlib.crc32(str(r["k"]).encode()) % 5 for r in got)


def test_held_out_accuracy(spark):
    from tideclock.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op10_quality_classifier"](spark, sf).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(got[d], q) for d, q in labels if got[d]["held_out"]]
    assert len(held) > 40 and all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([r["predicted"] == q for r, q in held]) > 0.9
    assert np.mean([r["predicted"] == 0 for r, q in held if q == 0]) > 0.7


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a", "b"), (2, "", "a", "b"), (None, "some words", "a", "b"), (2, "", "a", "b")], "doc_id bigint, text string, score string, x string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id bigint, quality int")
    got = M.score_documents(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in M.score_documents(docs, labels.limit(0)).collect()} == {M.DEFAULT_PRIOR}
    assert M.score_documents(docs.limit(0), labels).count() == 0
