"""Contract rules, each broken on purpose."""

import pytest

from tests.reference_support import ARRIVED, START, case, event, frames, simple
from tideclock.operators import contracts as C
from tideclock.plans.policy import ReplayError


def violated(spark, rows, cases=None):
    catalog, log = frames(spark, rows, cases)
    report = C.check_catalog(catalog).unionByName(C.check_log(log, C.typed_catalog(catalog)))
    return {r["rule"]: r["violations"] for r in report.collect() if r["violations"]}


def changed(index=0, **values):
    rows = simple([0, 6, 12])
    rows[index] |= values
    return rows


def test_sound_log(spark):
    rows = simple([0, 6, 12, 18, 24])
    assert violated(spark, [*rows, dict(rows[0])]) == {}
    catalog, log = frames(spark, rows)
    typed = C.validate(catalog, log)
    assert typed[1].count() == 5 and typed[0].first()["registered_epoch"] == START


@pytest.mark.parametrize(
    ("rows", "rule"),
    [
        (changed(case_id="C9"), "unknown_case"),
        (changed(delivery_id="a b"), "bad_delivery_id"),
        (changed(event_id=""), "bad_event_id"),
        (changed(delivery_seq="0"), "bad_delivery_seq"),
        (changed(delivery_seq=" 1"), "bad_delivery_seq"),
        (changed(revision="-1"), "bad_revision"),
        (changed(operation="DELETE"), "unknown_operation"),
        (changed(event_type="OTHER"), "unknown_stage"),
        (changed(operation="RETRACT"), "retraction_with_time"),
        (changed(event_time=""), "bad_event_time"),
        (changed(event_time="2026-01-01T00:00:00"), "bad_event_time"),
        (changed(event_time="2026-01-09T00:00:00Z"), "event_after_recording"),
        (changed(recorded_at="x"), "bad_recorded_at"),
        (changed(recorded_at="2025-12-31T00:00:00Z"), "recorded_before_registration"),
        (changed(synthetic_record="false"), "delivery_marker"),
        (changed(synthetic_record=None), "delivery_marker"),
        (changed(1, delivery_id="D1"), "delivery_payload_conflict"),
        (changed(1, delivery_seq="1"), "delivery_seq_conflict"),
        ([*simple([0, 6]), event(3, "NOTIFIED", START)], "version_payload_conflict"),
        ([*simple([0, 6]), event(3, "NOTIFIED", None, operation="RETRACT")], "version_payload_conflict"),
        ([*simple([0, 6]), event(3, "VISITED", START, event_id="C1-NOTIFIED", revision=2)], "event_identity_conflict"),
        ([*simple([0, 6]), event(3, "VISITED", START, recorded=ARRIVED - 1)], "sequence_against_recorded"),
    ],
)
def test_each_rule(spark, rows, rule):
    assert rule in violated(spark, rows)


@pytest.mark.parametrize(
    ("cases", "rule"),
    [
        ([case(), case()], "repeated_case_id"),
        ([case(group="FLOW_C")], "unknown_service_group"),
        ([case() | {"registered_at": "2026-01-01"}], "bad_registered_at"),
        ([case(), case("bad id")], "bad_case_id"),
        ([case() | {"synthetic_record": None}], "case_marker"),
    ],
)
def test_catalog_rules(spark, cases, rule):
    assert rule in violated(spark, simple([0]), cases)


def test_empty_tables_fail(spark):
    catalog, log = frames(spark, simple([0]))
    for bad in ((catalog.limit(0), log), (catalog, log.limit(0))):
        with pytest.raises(ReplayError):
            C.validate(*bad)


def test_inversion_across_ranges(spark):
    rows = [event(i + 1, "ISSUED", START, recorded=ARRIVED + 60 * i, case=f"C{i}") for i in range(50)]
    rows[30]["recorded_at"] = rows[0]["recorded_at"]
    _, log = frames(spark, rows)
    for ranges in (1, 7, 4096):
        assert C.sequence_inversions(C.typed_log(log), ranges).first()["violations"] == 1
