"""Case states, clocks, ages and stage durations from classified deliveries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tideclock.functions.scalars import hours
from tideclock.plans.policy import STAGES

ISSUES = ("no_observed_events", "ambiguous_stage", "missing_predecessor", "stage_reversal")


def stage_counts(actions: DataFrame) -> DataFrame:
    """(case_id, event_type, n, event_epoch, stage_index) of live events."""
    index = F.array_position(F.array(*(F.lit(s) for s in STAGES)), F.col("event_type")).cast("int")
    live = actions.filter(F.col("latest") & (F.col("operation") == "UPSERT"))
    return live.groupBy("case_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_epoch").alias("event_epoch")).withColumn("stage_index", index)


def _any(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def case_clocks(catalog: DataFrame, actions: DataFrame, as_of: int) -> DataFrame:
    """One row per case registered by ``as_of``; cases without deliveries are EMPTY.

    All of a case's facts are conditional aggregates of one pass over its
    deliveries. A reversal is a single-event stage before the latest of the
    single-event stages in front of it.
    """
    facts = []
    for i, stage in enumerate(STAGES, 1):
        here = F.col("latest") & (F.col("operation") == "UPSERT") & (F.col("event_type") == stage)
        facts += [F.sum(here.cast("long")).alias(f"n{i}"), F.min(F.when(here, F.col("event_epoch"))).alias(f"t{i}")]
    withdrawn = F.max((F.col("latest") & (F.col("operation") == "RETRACT") & (F.col("event_type") == STAGES[-1])).cast("int"))
    seen = actions.groupBy("case_id").agg(*facts, withdrawn.alias("withdrawn"), F.sum((F.col("action") == "accepted").cast("long")).alias("revisions"))
    known = catalog.filter(F.col("registered_epoch") <= F.lit(as_of)).select("case_id", "service_group")
    cases = known.join(seen, "case_id", "left")
    steps = range(1, len(STAGES) + 1)
    n = {i: F.coalesce(F.col(f"n{i}"), F.lit(0)) for i in steps}
    single = {i: F.when(n[i] == 1, F.col(f"t{i}")) for i in steps}
    active = reduce(lambda a, b: a + b, n.values())
    present = reduce(lambda a, b: a + b, [(n[i] > 0).cast("int") for i in steps])
    furthest = F.greatest(*(F.when(n[i] > 0, i).otherwise(0) for i in steps))
    reversal = _any([F.coalesce(single[i] < (F.greatest(*(single[j] for j in steps if j < i)) if i > 2 else single[1]), F.lit(False)) for i in steps if i > 1])
    cases = cases.select(
        "case_id",
        "service_group",
        (active == 0).alias("no_observed_events"),
        _any([n[i] > 1 for i in steps]).alias("ambiguous_stage"),
        (present != furthest).alias("missing_predecessor"),
        reversal.alias("stage_reversal"),
        present.alias("present_count"),
        F.coalesce("revisions", F.lit(0)).alias("projection_revision"),
        single[1].alias("issue_epoch"),
        single[2].alias("notification_epoch"),
        single[5].alias("decision_epoch"),
        F.coalesce("withdrawn", F.lit(0)).alias("decision_retracted"),
        F.array(*(F.when(n[i] > 0, F.col(f"t{i}")) for i in steps)).alias("stage_epochs"),
    )
    state = F.when(F.col("no_observed_events"), "EMPTY").when(F.col("ambiguous_stage") | F.col("missing_predecessor") | F.col("stage_reversal"), "REVIEW").when(F.col("present_count") == len(STAGES), "COMPLETE").otherwise("OPEN")
    cases = cases.withColumn("state", state)
    done, running = F.col("state") == "COMPLETE", F.col("state") == "OPEN"
    return cases.select(
        "*",
        F.when(done, hours(F.col("decision_epoch") - F.col("issue_epoch"))).alias("issue_to_decision_hours"),
        F.when(done, hours(F.col("decision_epoch") - F.col("notification_epoch"))).alias("notification_to_decision_hours"),
        F.when(running, hours(F.lit(as_of) - F.col("issue_epoch"))).alias("issue_age_hours"),
        F.when(running, hours(F.lit(as_of) - F.col("notification_epoch"))).alias("notification_age_hours"),
        F.array_sort(F.array_compact(F.array(*(F.when(F.col(i), i) for i in ISSUES)))).alias("issues"),
    )


def stage_durations(clocks: DataFrame) -> DataFrame:
    """(case_id, from_stage, to_stage, duration_hours) of complete and open cases, whose stages are a prefix."""
    gaps = [
        F.when(
            F.col("stage_epochs")[i + 1].isNotNull(),
            F.struct(F.lit(STAGES[i]).alias("from_stage"), F.lit(STAGES[i + 1]).alias("to_stage"), hours(F.col("stage_epochs")[i + 1] - F.col("stage_epochs")[i]).alias("duration_hours")),
        )
        for i in range(len(STAGES) - 1)
    ]
    sound = clocks.filter(F.col("state").isin("COMPLETE", "OPEN"))
    return sound.select("case_id", F.explode(F.array_compact(F.array(*gaps))).alias("g")).select("case_id", "g.*")


def partition_check(clocks: DataFrame, durations: DataFrame) -> DataFrame:
    """Complete cases whose stage durations do not add up to their clocks."""
    sums = durations.groupBy("case_id").agg(F.sum("duration_hours").alias("whole"), F.sum(F.when(F.col("from_stage") != STAGES[0], F.col("duration_hours"))).alias("noticed"))
    joined = clocks.filter("state = 'COMPLETE'").join(sums, "case_id", "left")
    off = (F.abs(F.col("issue_to_decision_hours") - F.col("whole")) > 1e-10) | (F.abs(F.col("notification_to_decision_hours") - F.col("noticed")) > 1e-10) | F.col("whole").isNull()
    return joined.filter(off).select("case_id", "issue_to_decision_hours", "whole", "notification_to_decision_hours", "noticed")
