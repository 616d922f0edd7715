"""Policies, instants and scalar functions."""

import json

import pytest
from pyspark.sql import functions as F

from tideclock.functions import scalars as S
from tideclock.plans import policy as P

INSTANTS = {
    "2026-01-01T00:00:00Z": 1767225600,
    "2026-01-01T05:30:00+05:30": 1767225600,
    "2025-12-31T00:01:00-23:59": 1767225600,
    "2026-01-01T23:59:00+23:59": 1767225600,
    "0001-01-01T00:00:00Z": -62135596800,
    "9999-12-31T23:59:59Z": 253402300799,
    "0001-01-01T00:00:00+00:01": None,
    "9999-12-31T23:59:59-00:01": None,
    "2026-01-01T00:00:00": None,
    "2026-01-01 00:00:00Z": None,
    "2026-01-01T00:00:00.5Z": None,
    "2026-01-01T24:00:00Z": None,
    "2026-01-01T23:59:60Z": None,
    "2026-02-30T00:00:00Z": None,
    "2026-01-01T00:00:00+24:00": None,
    "2026-01-01T00:00:00+00:60": None,
    "2026-01-01T00:00:00Z\n": None,
    "": None,
}


def test_instants(spark):
    rows = spark.createDataFrame([(t,) for t in [*INSTANTS, None]], "t string").select("t", S.instant_epoch(F.col("t")).alias("e")).collect()
    assert {r["t"]: r["e"] for r in rows} == {**INSTANTS, None: None}
    for text, epoch in INSTANTS.items():
        if epoch is None:
            with pytest.raises(P.ReplayError):
                P.instant(text)
        else:
            assert P.instant(text) == epoch
    back = spark.createDataFrame([(-62135596800,), (1767225600,), (None,)], "e bigint").select(S.instant_text(F.col("e"))).collect()
    assert [r[0] for r in back] == ["0001-01-01T00:00:00Z", "2026-01-01T00:00:00Z", None]
    assert P.instant_text(-62135596800) == "0001-01-01T00:00:00Z" and P.instant_text(None) == ""


def test_scalars(spark):
    values = ["1", "0", "-1", " 1", "1_0", "+1", "1.5", "nan", "inf", "-Infinity", "1e400", "", None, "a b", " a", "a\n", "Ab_-9", "x" * 65, "2026-01-31", "2026-02-30", "99999999999999999999"]
    row = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = row.select("v", S.positive_int(F.col("v")).alias("p"), S.nonnegative_int(F.col("v")).alias("n"), S.finite_real(F.col("v")).alias("r"), S.bit(F.col("v")).alias("b"), S.is_identifier(F.col("v")).alias("id"), S.is_trimmed(F.col("v")).alias("t"), S.iso_date(F.col("v")).alias("d")).collect()
    by = {r["v"]: r for r in got}
    assert {k for k, r in by.items() if r["p"] is not None} == {"1"}
    assert {k for k, r in by.items() if r["n"] is not None} == {"0", "1"}
    assert by["1.5"]["r"] == 1.5 and all(by[k]["r"] is None for k in ("nan", "inf", "-Infinity", "1e400", "a b", ""))
    assert {k for k, r in by.items() if r["b"] is not None} == {"0", "1"}
    assert by["Ab_-9"]["id"] and not any(by[k]["id"] for k in ("a b", "a\n", "x" * 65, "", None))
    assert by["a b"]["t"] and not any(by[k]["t"] for k in (" a", "a\n", "", None))
    assert {k for k, r in by.items() if r["d"] is not None} == {"2026-01-31"}


def test_policy_round_trip():
    policy = P.Policy()
    assert P.parse_policy(json.loads(policy.to_json())) == policy and P.load_policy() == policy
    assert policy.lateness == 86400


@pytest.mark.parametrize(
    "change",
    [
        {"protocol": "other"}, {"stages": ("ISSUED",)}, {"service_groups": ("FLOW_A",)}, {"late_policy": "drop"}, {"synthetic_only": False}, {"synthetic_only": 1},
        {"establishes_legal_breach": True}, {"establishes_wrongdoing": True}, {"mad_scale_floor": 0}, {"mad_scale_floor": float("nan")}, {"open_age_hours": float("inf")},
        {"duration_score_threshold": True}, {"allowed_lateness_hours": 1 / 7}, {"allowed_lateness_hours": -1}, {"seed": -1}, {"seed": 1.5}, {"minimum_baseline_cases": 2},
        {"training_cases": 0}, {"observed_at": "2026-01-15T00:00:00Z"}, {"observed_at": "2026-01-20"},
    ],
)
def test_bad_policies(change):
    with pytest.raises(P.ReplayError):
        P.Policy(**change)


def test_policy_keys():
    made = json.loads(P.Policy().to_json())
    for bad in (made | {"more": 1}, {k: v for k, v in made.items() if k != "seed"}, made | {"generation": {"training_cases": 1}}, []):
        with pytest.raises(P.ReplayError):
            P.parse_policy(bad)
