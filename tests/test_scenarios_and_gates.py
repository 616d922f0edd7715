"""The labelled scenarios, the frozen baseline, and gates that must notice corruption."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from tideclock.operators import contracts, scores as S
from tideclock.plans import derived, gates as G, scenarios
from tideclock.plans.policy import Policy, ReplayError, instant
from tideclock.plans.snapshot import Results, baseline, evaluate, replay
from tideclock.sources.tables import materialize

POLICY = Policy()


@pytest.fixture(scope="module")
def world(spark):
    catalog, log = scenarios.synthetic_tables(spark)
    typed = tuple(materialize(t, "typed") for t in contracts.validate(catalog, log))
    got = evaluate(*typed, POLICY)
    names = ("audit", "effective", "clocks", "durations")
    snap = dataclasses.replace(got.snapshot, **{n: materialize(getattr(got.snapshot, n), n) for n in names})
    rest = {f.name: materialize(getattr(got, f.name), f.name) for f in dataclasses.fields(Results) if f.name not in ("snapshot", "document")}
    return typed, Results(snap, **rest, document=got.document)


def counted(table, column):
    return {r[column]: r["count"] for r in table.groupBy(column).count().collect()}


def test_published_counts(world):
    (catalog, log), got = world
    assert (catalog.count(), log.count(), got.snapshot.audit.count()) == (108, 540, 539)
    assert counted(got.snapshot.audit, "action") == {"accepted": 535, "duplicate_delivery": 1, "duplicate_version": 2, "stale_revision": 1}
    assert counted(got.snapshot.effective, "operation") == {"UPSERT": 532, "RETRACT": 1}
    assert got.snapshot.audit.filter("late_update = 1").count() == 3
    assert counted(got.snapshot.clocks, "state") == {"COMPLETE": 102, "OPEN": 2, "REVIEW": 3, "EMPTY": 1}
    assert counted(got.members, "service_group") == {"FLOW_A": 30, "FLOW_B": 30}
    assert (got.scores.count(), got.scores.filter("flagged = 1").count()) == (42, 1)
    assert (got.queue.count(), got.queue.select("case_id").distinct().count()) == (18, 11)


def test_scenarios_have_exactly_their_reasons(world):
    _, got = world
    states = {r["case_id"]: r["state"] for r in got.snapshot.clocks.filter("case_id LIKE 'SIM%'").collect()}
    reasons = {k: set() for k in scenarios.EXPECTED}
    for r in got.queue.collect():
        reasons[r["case_id"]].add(r["reason"])
        assert json.loads(r["evidence_json"])
    assert {k: (states[k], reasons[k]) for k in states} == scenarios.EXPECTED


def test_before_the_fixes_arrive(spark, world):
    (catalog, log), _ = world
    early = replay(catalog, log, instant("2026-01-25T00:00:00Z"), POLICY.lateness).clocks
    got = {r["case_id"]: r["state"] for r in early.filter("case_id IN ('SIM_CORRECT', 'SIM_RETRACT', 'SIM_LATE')").collect()}
    assert got == {"SIM_CORRECT": "REVIEW", "SIM_RETRACT": "COMPLETE", "SIM_LATE": "REVIEW"}


def test_empty_snapshot_right_after_the_cutoff(world):
    (catalog, log), _ = world
    got = evaluate(catalog, log, POLICY.with_(observed_at="2026-01-15T01:00:00Z"))
    assert got.scores.count() == 0 and got.queue.filter("category = 'duration_candidate'").count() == 0


def test_later_corrections_do_not_move_the_baseline(spark, world):
    (catalog, log), got = world
    late = log.filter("case_id = 'BASE0003' AND event_type = 'DECIDED'").withColumns({"revision": F.lit(2).cast("long"), "delivery_id": F.lit("NEW"), "delivery_seq": F.lit(10_000).cast("long"), "event_epoch": F.col("event_epoch") + 900_000, "recorded_epoch": F.lit(instant("2026-01-31T00:00:00Z")).cast("long")})
    members, found = baseline(catalog, log.unionByName(late), POLICY)
    order = ["service_group"]
    assert found.orderBy(*order).collect() == got.profiles.orderBy(*order).collect()
    scored = S.duration_scores(replay(catalog, log.unionByName(late), POLICY.observed, POLICY.lateness).clocks, members, found, POLICY)
    assert scored.filter("case_id = 'BASE0003'").count() == 0


def test_support_floor_and_thresholds(spark, world, data):
    (catalog, log), got = world
    with pytest.raises(ReplayError):
        baseline(catalog, log, POLICY.with_(minimum_baseline_cases=31))
    with pytest.raises(ReplayError):
        evaluate(derived.catalog(spark, data), derived.log(spark, data), derived.POLICY.with_(minimum_baseline_cases=12))
    flat = spark.createDataFrame([(str(i), "FLOW_A", 2.0) for i in range(5)], "case_id string, service_group string, value double")
    assert S.profiles(flat, 0.1).first().asDict() == {"service_group": "FLOW_A", "count": 5, "log_median": 2.0, "log_mad": 0.0, "scale": 0.1}
    long = got.scores.filter("flagged = 1").first()
    for change in ({"duration_score_threshold": long["upper_tail_score"]}, {"absolute_duration_hours": long["duration_hours"]}):
        again = S.duration_scores(got.snapshot.clocks, got.members, got.profiles, POLICY.with_(**change))
        assert again.filter("flagged = 1").count() == 0
    alone = S.duration_scores(got.snapshot.clocks, got.members, got.profiles.filter("service_group = 'FLOW_A'"), POLICY)
    with pytest.raises(Exception, match="no profile for the service group FLOW_B"):
        alone.collect()


@pytest.fixture(scope="module")
def both(world):
    """The tables of both derivations."""
    typed, got = world
    judged = G.judged_tables(got)
    return G.expected_tables(*typed, judged["audit"], POLICY) | judged


def edit(table, where, **columns):
    return table.withColumns({k: F.when(F.expr(where), F.expr(v).cast(table.schema[k].dataType)).otherwise(F.col(k)) for k, v in columns.items()})


def test_gates_pass(both):
    rows = G.compare(both, POLICY).collect()
    assert len(rows) == 26 and not [r for r in rows if r["failures"]]


MUTATIONS = {
    "E01": ("catalog", lambda t: t.unionByName(t.limit(1))),
    "E02": ("log", lambda t: edit(t, "delivery_seq = 3", synthetic_record="NULL")),
    "E03": ("log", lambda t: edit(t, "delivery_seq = 3", event_epoch="recorded_epoch + 1")),
    "E04": ("log", lambda t: edit(t, "delivery_seq = 3", event_type="'OTHER'")),
    "E05": ("log", lambda t: t.unionByName(t.filter("delivery_seq = 3").withColumn("delivery_id", F.lit("ZZZ")))),
    "E06": ("audit", lambda t: t.filter("ingest_index <> 7")),
    "E07": ("audit", lambda t: edit(t, "ingest_index = 7", action="'stale_revision'")),
    "E08": ("audit", lambda t: edit(t, "ingest_index = 7", watermark_before="watermark_before + 1")),
    "E09": ("audit", lambda t: edit(t, "ingest_index = 7", case_revision="case_revision + 1")),
    "E10": ("effective", lambda t: t.unionByName(t.limit(1))),
    "E11": ("effective", lambda t: edit(t, "operation = 'RETRACT'", operation="'UPSERT'")),
    "E12": ("clocks", lambda t: t.filter("case_id <> 'SIM_OPEN'")),
    "E13": ("clocks", lambda t: edit(t, "case_id = 'SIM_GAP'", state="'OPEN'")),
    "E14": ("clocks", lambda t: edit(t, "case_id = 'SIM_OPEN'", issue_epoch="issue_epoch + 1")),
    "E15": ("clocks", lambda t: edit(t, "case_id = 'SIM_LONG'", issue_to_decision_hours="issue_to_decision_hours + 1")),
    "E16": ("clocks", lambda t: edit(t, "case_id = 'SIM_OPEN'", issue_age_hours="NULL")),
    "E17": ("durations", lambda t: t.filter("NOT (case_id = 'SIM_LONG' AND from_stage = 'VISITED')")),
    "E18": ("durations", lambda t: edit(t, "case_id = 'SIM_LONG'", duration_hours="duration_hours + 1")),
    "E19": ("clocks", lambda t: edit(t, "case_id = 'SIM_OPEN'", issue_to_decision_hours="1.0")),
    "E20": ("members", lambda t: t.limit(59)),
    "E21": ("profiles", lambda t: edit(t, "service_group = 'FLOW_A'", scale="scale * 2")),
    "E22": ("scores", lambda t: t.filter("case_id <> 'SIM_LONG'")),
    "E23": ("scores", lambda t: edit(t, "case_id = 'SIM_LONG'", flagged="0")),
    "E24": ("queue", lambda t: edit(t, "case_id = 'SIM_GAP'", establishes_wrongdoing="'true'")),
    "E25": ("queue", lambda t: t.filter("reason <> 'stage_reversal'")),
    "E26": ("queue", lambda t: edit(t, "case_id = 'SIM_GAP'", evidence_json="'{'")),
}


@pytest.mark.parametrize("gate", sorted(MUTATIONS))
def test_every_gate_notices(both, gate):
    where, change = MUTATIONS[gate]
    name = next(n for n in G.gate_queries(POLICY) if n.startswith(gate))
    assert G.compare(both | {where: change(both[where])}, POLICY, [name]).first()["failures"] > 0
