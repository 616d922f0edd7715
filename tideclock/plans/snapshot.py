"""The whole replay: named tables of a snapshot, its baseline and what is judged by them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tideclock.operators import clocks as C, replay as R, scores as S
from tideclock.plans.policy import Policy, ReplayError
from tideclock.sources.tables import digest_of, fingerprint, materialize


@dataclass(frozen=True)
class Snapshot:
    """The tables derived from one log at one instant."""

    as_of: int
    audit: DataFrame
    effective: DataFrame
    clocks: DataFrame
    durations: DataFrame


def classified(log: DataFrame, as_of: int) -> DataFrame:
    """The classified deliveries, written down: every table of a snapshot is made from them."""
    return materialize(R.classify(log, as_of), "classified")


def replay(catalog: DataFrame, log: DataFrame, as_of: int, lateness: int) -> Snapshot:
    actions = classified(log, as_of)
    found = C.case_clocks(catalog, actions, as_of)
    return Snapshot(as_of, R.with_watermark(actions, lateness), R.effective(actions), found, C.stage_durations(found))


@dataclass(frozen=True)
class Results:
    """A snapshot with its frozen baseline, scores and review queue."""

    snapshot: Snapshot
    members: DataFrame
    profiles: DataFrame
    scores: DataFrame
    queue: DataFrame
    document: dict = field(default_factory=dict)


def baseline(catalog: DataFrame, log: DataFrame, policy: Policy, support: bool = True) -> tuple[DataFrame, DataFrame]:
    """Members and profiles, from the snapshot at the cutoff alone: later corrections cannot move them."""
    members = materialize(S.baseline_members(C.case_clocks(catalog, classified(log, policy.cutoff), policy.cutoff)), "members")
    found = materialize(S.profiles(members, policy.mad_scale_floor), "profiles")
    return members, S.require_support(found, policy) if support else found


def baseline_document(members: DataFrame, found: DataFrame, policy: Policy) -> dict:
    """The frozen baseline as one small document: what it was fitted on, by which rule, and the profiles.

    The training cases are named by their number and a digest of them; their
    list is a table. A row for each declared group comes to the driver.
    """
    training = fingerprint(members.select("case_id", "service_group")).first()
    return {
        "protocol": policy.protocol,
        "baseline_cutoff": policy.baseline_cutoff,
        "clock": "notification_to_decision_hours",
        "training": {"cases": training["rows"], "digest": training["digest"]},
        "profiles": {r["service_group"]: {k: r[k] for k in ("count", "log_median", "log_mad", "scale")} for r in found.collect()},
        "rule": f"(log1p(hours) - log_median) / max({S.MAD_TO_SIGMA} * log_mad, floor)",
        "mad_scale_floor": policy.mad_scale_floor,
        "duration_score_threshold": policy.duration_score_threshold,
        "absolute_duration_hours": policy.absolute_duration_hours,
        "synthetic_only": True,
    }


def evaluate(catalog: DataFrame, log: DataFrame, policy: Policy, support: bool = True) -> Results:
    """The snapshot at ``policy.observed_at`` and all that is judged by it."""
    if policy.cutoff >= policy.observed:
        raise ReplayError("the baseline cutoff must be before the snapshot")
    snap = replay(catalog, log, policy.observed, policy.lateness)
    members, found = baseline(catalog, log, policy, support)
    document = baseline_document(members, found, policy)
    scored = S.duration_scores(snap.clocks, members, found, policy, digest_of(document))
    return Results(snap, members, found, scored, S.review_queue(snap.clocks, snap.audit, scored, policy), document)


def parameters(policy: Policy, spark) -> DataFrame:
    """The two snapshots as rows, for queries that take both at once."""
    return spark.createDataFrame([("OBS", policy.observed), ("BASE", policy.cutoff)], "kind string, as_of bigint").withColumn("lateness_seconds", F.lit(policy.lateness).cast("long"))
