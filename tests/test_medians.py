"""Exact medians against the plain ones."""

import random
import statistics

from tideclock.operators.medians import exact_medians


def test_medians(spark):
    rng = random.Random(4)
    groups = {"one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 501, "even": [rng.random() for _ in range(4000)], "odd": [rng.gauss(0, 9) for _ in range(3001)], "ties": [float(rng.randrange(3)) for _ in range(2000)], "far": [*map(float, range(99)), 1e300]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None), (None, 5.0)]
    got = {r["g"]: (r["count"], r["median"]) for r in exact_medians(spark.createDataFrame(rows, "g string, v double").repartition(7), "g", "v").collect()}
    assert {k: v for k, v in got.items() if k} == {g: (len(vs), statistics.median(vs)) for g, vs in groups.items()}
    assert exact_medians(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0
