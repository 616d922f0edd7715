"""Replay semantics on small logs, and invariance under order and partitioning."""

import random

import pytest
from pyspark.sql import functions as F

from tests.reference_support import ARRIVED, AS_OF, START, case, event, simple, typed
from tideclock.operators import replay as R
from tideclock.plans import derived
from tideclock.plans.policy import ReplayError, lateness_seconds
from tideclock.plans.snapshot import replay

DAY = 86400


def snap(spark, rows, as_of=AS_OF, lateness=DAY, cases=None):
    return replay(*typed(spark, rows, cases), as_of, lateness)


def audit(snapshot):
    return [r.asDict() for r in snapshot.audit.orderBy("ingest_index").collect()]


def test_complete_case(spark):
    got = snap(spark, simple([0, 6, 12, 18, 24]))
    row = got.clocks.first()
    assert (row["state"], row["issue_to_decision_hours"], row["notification_to_decision_hours"]) == ("COMPLETE", 24, 18)
    assert row["issue_age_hours"] is None and row["projection_revision"] == 5
    assert [(r["from_stage"], r["to_stage"], r["duration_hours"]) for r in got.durations.orderBy("from_stage").collect()] == [("ISSUED", "NOTIFIED", 6), ("NOTIFIED", "VISITED", 6), ("REPORTED", "DECIDED", 6), ("VISITED", "REPORTED", 6)]


def test_open_case(spark):
    row = snap(spark, simple([0, 6, 12])).clocks.first()
    assert (row["state"], row["issue_age_hours"], row["notification_age_hours"], row["issue_to_decision_hours"]) == ("OPEN", 120, 114, None)


def test_equal_times_are_no_reversal(spark):
    row = snap(spark, simple([0, 0, 1, 2, 3])).clocks.first()
    assert (row["state"], row["issue_to_decision_hours"], row["notification_to_decision_hours"]) == ("COMPLETE", 3, 3)


def test_lateness_is_strict(spark):
    rows = audit(snap(spark, simple([0, 3, 2, 2 - 1 / 3600]), lateness=3600))
    assert [r["late_update"] for r in rows] == [0, 0, 0, 1]
    assert [r["watermark_before"] for r in rows] == [None, START - 3600, START + 7200, START + 7200]


@pytest.mark.parametrize(("offsets", "issues"), [([0, 6, 5], ["stage_reversal"]), ([6, 0, 3, 2], ["stage_reversal"])])
def test_reversals(spark, offsets, issues):
    row = snap(spark, simple(offsets)).clocks.first()
    assert row["state"] == "REVIEW" and row["issues"] == issues


def test_several_issues_and_ambiguity(spark):
    rows = [event(1, "ISSUED", START), event(2, "VISITED", START + 9), event(3, "VISITED", START + 5, event_id="C1-VISITED-2"), event(4, "DECIDED", START - 5)]
    row = snap(spark, rows).clocks.first()
    assert row["issues"] == ["ambiguous_stage", "missing_predecessor", "stage_reversal"]


def test_empty_and_unregistered_cases(spark):
    cases = [case(), case("C2"), case("C3", at=AS_OF + 1)]
    got = {r["case_id"]: r for r in snap(spark, simple([0]), cases=cases).clocks.collect()}
    assert {k: r["state"] for k, r in got.items()} == {"C1": "OPEN", "C2": "EMPTY"}
    assert got["C2"]["issues"] == ["no_observed_events"] and got["C2"]["projection_revision"] == 0


def test_actions_and_latest(spark):
    rows = [
        event(1, "ISSUED", START, revision=2),
        event(2, "ISSUED", START + 1, revision=1),
        event(3, "ISSUED", START, revision=2),
        event(4, "ISSUED", None, revision=3, operation="RETRACT"),
        event(5, "ISSUED", START + 2, revision=5),
    ]
    rows.insert(1, dict(rows[0]))
    got = snap(spark, rows)
    assert [r["action"] for r in audit(got)] == ["accepted", "duplicate_delivery", "stale_revision", "duplicate_version", "accepted", "accepted"]
    assert [(r["revision"], r["operation"]) for r in got.effective.collect()] == [(5, "UPSERT")]
    assert [r["case_revision"] for r in audit(got)] == [1, 1, 1, 1, 2, 3]


def test_probe_of_retraction_is_the_last_version_even_if_a_tombstone(spark):
    rows = [event(1, "ISSUED", START), event(2, "NOTIFIED", START + 40 * 3600), event(3, "ISSUED", None, revision=2, operation="RETRACT"), event(4, "ISSUED", None, revision=3, operation="RETRACT")]
    rows.append(event(5, "VISITED", None, operation="RETRACT"))
    got = audit(snap(spark, rows, lateness=3600))
    assert [r["probe_epoch"] for r in got] == [START, START + 40 * 3600, START, None, None]
    assert [r["late_update"] for r in got] == [0, 0, 1, 0, 0]


def test_future_arrivals_do_not_count(spark):
    rows = [*simple([0, 6]), event(9, "VISITED", START + 7, recorded=AS_OF + 1)]
    got = snap(spark, rows)
    assert got.audit.count() == 2
    meta = R.snapshot_metadata(got.audit, typed(spark, rows)[1]).first()
    assert (meta["consumed_deliveries"], meta["excluded_future_deliveries"], meta["active_events"]) == (2, 1, 2)
    assert snap(spark, rows, as_of=ARRIVED - 1).audit.count() == 0


def test_order_and_partitioning_do_not_matter(spark, data, monkeypatch):
    log, catalog = derived.log(spark, data), derived.catalog(spark, data)
    rows = log.collect()
    random.Random(1).shuffle(rows)
    mixed = spark.createDataFrame(rows, log.schema).repartition(7)
    one = audit(replay(catalog, log, derived.OBSERVED, DAY))
    assert audit(replay(catalog, mixed, derived.OBSERVED, DAY)) == one
    monkeypatch.setattr(R, "RANGES", 3)
    assert audit(replay(catalog, mixed, derived.OBSERVED, DAY)) == one
    assert [r["ingest_index"] for r in one] == list(range(1, len(one) + 1))


def test_an_extra_copy_changes_its_counter_only(spark, data):
    log = derived.log(spark, data)
    more = log.unionByName(log.filter("delivery_seq = 5").withColumn("input_index", F.col("input_index") + 1_000_000_000))
    count = lambda x: {r["action"]: r["count"] for r in R.classify(x, derived.OBSERVED).groupBy("action").count().collect()}
    a, b = count(log), count(more)
    assert b.pop("duplicate_delivery") == a.pop("duplicate_delivery") + 1 and a == b


def test_expected_counts_of_the_derived_log(spark, data):
    actions = {r["action"]: r["count"] for r in R.classify(derived.log(spark, data), derived.OBSERVED).groupBy("action").count().collect()}
    assert actions == {"accepted": 909, "duplicate_delivery": 31, "duplicate_version": 21, "stale_revision": 16}


def test_bad_lateness():
    for bad in (0, -1, float("nan"), True, "24", 1 / 7):
        with pytest.raises(ReplayError):
            lateness_seconds(bad)
