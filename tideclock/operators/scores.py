"""The frozen duration baseline, scores against it, and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideclock.functions.scalars import alert_id
from tideclock.operators.clocks import ISSUES
from tideclock.operators.medians import exact_medians
from tideclock.plans.policy import Policy, ReplayError

#: Fixed value: scales a median absolute deviation to a normal deviation.
MAD_TO_SIGMA = 1.4826


def baseline_members(clocks: DataFrame) -> DataFrame:
    """Complete cases of the snapshot at the cutoff, with their log durations."""
    return clocks.filter("state = 'COMPLETE'").select("case_id", "service_group", F.log1p("notification_to_decision_hours").alias("value"))


def profiles(members: DataFrame, floor: float) -> DataFrame:
    """(service_group, count, log_median, log_mad, scale); exact medians."""
    centres = exact_medians(members, "service_group", "value").withColumnRenamed("median", "log_median")
    apart = members.join(F.broadcast(centres), "service_group")  # a row for each declared group
    apart = apart.select("service_group", F.abs(F.col("value") - F.col("log_median")).alias("apart"))
    spread = exact_medians(apart, "service_group", "apart").select("service_group", F.col("median").alias("log_mad"))
    found = centres.join(F.broadcast(spread), "service_group")
    return found.withColumn("scale", F.greatest(F.lit(MAD_TO_SIGMA) * F.col("log_mad"), F.lit(float(floor))))


def require_support(found: DataFrame, policy: Policy) -> DataFrame:
    """The profiles, if every declared group has enough cases."""
    counts = {r["service_group"]: r["count"] for r in found.select("service_group", "count").collect()}
    short = [g for g in policy.service_groups if counts.get(g, 0) < policy.minimum_baseline_cases]
    if short:
        raise ReplayError(f"too few completed cases at the cutoff: {', '.join(short)}")
    return found


def duration_scores(clocks: DataFrame, members: DataFrame, found: DataFrame, policy: Policy, baseline_hash: str | None = None) -> DataFrame:
    """Scores of complete cases outside the baseline, with all that they were judged by; a case whose group has no profile is an error."""
    fresh = clocks.filter("state = 'COMPLETE'").join(members.select("case_id"), "case_id", "left_anti")
    joined = fresh.join(F.broadcast(found.select("service_group", "log_median", "scale")), "service_group", "left")
    log_duration = F.log1p("notification_to_decision_hours")
    no_profile = F.raise_error(F.concat(F.lit("no profile for the service group "), F.coalesce("service_group", F.lit("null")))).cast("double")
    scored = joined.select(
        "case_id",
        "service_group",
        F.col("notification_to_decision_hours").alias("duration_hours"),
        log_duration.alias("log_duration"),
        F.col("log_median").alias("baseline_median"),
        F.col("scale").alias("baseline_scale"),
        F.when(F.col("scale").isNull(), no_profile).otherwise((log_duration - F.col("log_median")) / F.col("scale")).alias("upper_tail_score"),
        F.lit(float(policy.duration_score_threshold)).alias("score_threshold"),
        F.lit(float(policy.absolute_duration_hours)).alias("absolute_floor_hours"),
        F.lit(policy.baseline_cutoff).alias("baseline_cutoff"),
        F.lit(baseline_hash).cast("string").alias("baseline_hash"),
        F.lit("true").alias("synthetic_record"),
    )
    high = (F.col("upper_tail_score") > F.col("score_threshold")) & (F.col("duration_hours") > F.col("absolute_floor_hours"))
    return scored.withColumn("flagged", high.cast("int"))


def _alert(condition: Column, priority: str, category: str, reason: str, evidence: Column) -> Column:
    return F.when(condition, F.struct(F.lit(priority).alias("priority"), F.lit(category).alias("category"), F.lit(reason).alias("reason"), F.to_json(evidence, {"ignoreNullFields": "false"}).alias("evidence_json")))


def review_queue(clocks: DataFrame, audit: DataFrame, scores: DataFrame, policy: Policy) -> DataFrame:
    """Candidates for review, at most one per case and reason.

    The audit is summed by case once; every reason is then a condition on one
    row, and the reasons that hold are exploded.
    """
    ordered = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct("ingest_index", "delivery_id")))), lambda x: x["delivery_id"])
    count = lambda action: F.sum((F.col("action") == action).cast("long")).alias(action)
    actions = ("duplicate_delivery", "duplicate_version", "stale_revision")
    revised = (F.col("action") == "accepted") & (F.col("revision") > 1)
    noted = audit.filter((F.col("action") != "accepted") | (F.col("late_update") == 1) | revised)
    history = noted.groupBy("case_id").agg(*map(count, actions), ordered(F.col("late_update") == 1).alias("late"), ordered(revised).alias("revised"))
    flagged = scores.filter("flagged = 1").select("case_id", "duration_hours", "upper_tail_score")
    rows = clocks.join(history, "case_id", "left").join(flagged, "case_id", "left")
    opened = F.col("state") == "OPEN"
    where = F.struct(F.col("decision_epoch"), F.col("issue_epoch"), F.col("notification_epoch"), F.lit(policy.observed).alias("observed_epoch"), F.col("state"))
    age = lambda column, clock, limit: F.struct(F.col(column).alias("age_hours"), F.lit(clock).alias("clock"), F.lit(False).alias("completed_duration_known"), F.lit(limit).alias("threshold_hours"))
    alerts = [_alert(F.array_contains("issues", i), "P1", "data_quality", i, where) for i in ISSUES]
    alerts += [
        _alert(opened & (F.col("decision_retracted") == 1), "P2", "process_pattern", "decision_withdrawn", F.struct(F.lit(True).alias("decision_retracted"), F.col("state"))),
        _alert(opened & (F.col("notification_age_hours") > float(policy.open_age_hours)), "P2", "process_pattern", "aged_open_case", age("notification_age_hours", "notification_to_observation", policy.open_age_hours)),
        _alert(opened & F.col("notification_epoch").isNull() & (F.col("issue_age_hours") > float(policy.notification_wait_hours)), "P2", "process_pattern", "awaiting_notification", age("issue_age_hours", "issue_to_observation", policy.notification_wait_hours)),
    ]
    alerts += [_alert(F.col(a) > 0, "P3", "delivery_quality", a, F.struct(F.col(a).alias("deliveries"), F.col("state").alias("projection_state"))) for a in actions]
    alerts += [
        _alert(F.size("late") > 0, "P3", "delivery_quality", "late_event_update", F.struct(F.col("late").alias("delivery_ids"), F.lit("retained_and_revised").alias("policy"))),
        _alert(F.size("revised") > 0, "P3", "delivery_quality", "revised_event_record", F.struct(F.col("revised").alias("delivery_ids"), F.col("projection_revision"))),
        _alert(
            F.col("upper_tail_score").isNotNull(),
            "P2",
            "duration_candidate",
            "duration_upper_tail",
            F.struct(F.lit(float(policy.absolute_duration_hours)).alias("absolute_floor_hours"), F.lit(policy.baseline_cutoff).alias("baseline_cutoff"), F.col("duration_hours"), F.lit(float(policy.duration_score_threshold)).alias("score_threshold"), F.col("upper_tail_score")),
        ),
    ]
    found = rows.select("case_id", "service_group", F.explode(F.array_compact(F.array(*alerts))).alias("a")).select("case_id", "service_group", "a.*")
    constants = {"status": "review_required", "establishes_legal_breach": "false", "establishes_wrongdoing": "false", "synthetic_record": "true"}
    return found.select(alert_id(F.col("case_id"), F.col("reason")).alias("alert_id"), "*", *(F.lit(v).alias(k) for k, v in constants.items()))
