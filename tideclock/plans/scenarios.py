"""A seeded synthetic log: routine cases and twelve labelled scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from tideclock.functions.scalars import instant_text, utc
from tideclock.plans.policy import STAGES, Policy, instant
from tideclock.sources.tables import write_csv

H = 3600
START = instant("2026-01-20T00:00:00Z")
LATE = instant("2026-01-31T00:00:00Z")

#: Scenario -> expected state and the full set of expected review reasons.
EXPECTED = {
    "SIM_LATE": ("COMPLETE", {"late_event_update"}),
    "SIM_ORDER": ("REVIEW", {"stage_reversal"}),
    "SIM_GAP": ("REVIEW", {"missing_predecessor"}),
    "SIM_REPEAT": ("REVIEW", {"ambiguous_stage"}),
    "SIM_OPEN": ("OPEN", {"aged_open_case"}),
    "SIM_LONG": ("COMPLETE", {"duration_upper_tail"}),
    "SIM_CORRECT": ("COMPLETE", {"revised_event_record", "late_event_update"}),
    "SIM_RETRACT": ("OPEN", {"decision_withdrawn", "aged_open_case", "duplicate_version", "late_event_update", "revised_event_record"}),
    "SIM_REV_ORDER": ("COMPLETE", {"revised_event_record", "stale_revision"}),
    "SIM_EMPTY": ("EMPTY", {"no_observed_events"}),
    "SIM_DUP": ("COMPLETE", {"duplicate_delivery", "duplicate_version"}),
    "SIM_CLOCK": ("COMPLETE", set()),
}

Row = tuple[str, str, str, int, str, int | None, int, int]


def _default(case: str, hours: tuple[float, ...] = (0, 12, 24, 36, 48), lag: int = 2) -> dict[str, Row]:
    """(case, stage, event suffix, revision, operation, event, recorded, copies) by stage."""
    return {s: (case, s, "", 1, "UPSERT", START + int(h * H), START + int(h * H) + lag * H, 1) for s, h in zip(STAGES, hours, strict=False)}


def _scenario_rows() -> list[Row]:
    rows: list[Row] = []

    def put(made: dict[str, Row], *more: Row) -> None:
        rows.extend([*made.values(), *more])

    late = _default("SIM_LATE")
    late["VISITED"] = (*late["VISITED"][:6], instant("2026-01-30T00:00:00Z"), 1)
    put(late)
    put(_default("SIM_ORDER", (0, 12, 24, 23, 48)))
    gap = _default("SIM_GAP")
    del gap["REPORTED"]
    put(gap)
    put(_default("SIM_REPEAT"), ("SIM_REPEAT", "VISITED", "-SECOND", 1, "UPSERT", START + 25 * H, START + 25 * H, 1))
    put(_default("SIM_OPEN", (0, 12, 24)))
    put(_default("SIM_LONG", (0, 24, 72, 96, 192)))
    after = instant("2026-02-02T00:00:00Z")
    put(_default("SIM_CORRECT", (0, 12, 24, 36, 24)), ("SIM_CORRECT", "DECIDED", "", 2, "UPSERT", START + 72 * H, LATE, 1), ("SIM_CORRECT", "DECIDED", "", 3, "UPSERT", after, after + 24 * H, 1))
    put(_default("SIM_RETRACT"), ("SIM_RETRACT", "DECIDED", "", 2, "RETRACT", None, LATE, 1), ("SIM_RETRACT", "DECIDED", "", 1, "UPSERT", START + 48 * H, LATE + H, 1))
    order = _default("SIM_REV_ORDER")
    order["DECIDED"] = ("SIM_REV_ORDER", "DECIDED", "", 2, "UPSERT", START + 72 * H, START + 72 * H, 1)
    put(order, ("SIM_REV_ORDER", "DECIDED", "", 1, "UPSERT", START + 24 * H, LATE, 1))
    dup = _default("SIM_DUP")
    dup["ISSUED"] = (*dup["ISSUED"][:7], 2)
    put(dup, ("SIM_DUP", "ISSUED", "", 1, "UPSERT", START, START + 72 * H, 1))
    put(_default("SIM_CLOCK", (0, 0, 24, 36, 48)))
    return rows


def _routine(spark: SparkSession, policy: Policy, prefix: str, count: int, origin: str, per_day: int) -> tuple[DataFrame, DataFrame]:
    """Complete cases whose stage gaps come from a hash of seed, case and stage."""
    i = F.col("id")
    ids = spark.range(count).select(i, F.concat(F.lit(prefix), F.lpad(i.cast("string"), 4, "0")).alias("case_id"), F.when(i % 2 == 0, "FLOW_A").otherwise("FLOW_B").alias("service_group"), (F.lit(instant(origin)) + F.floor(i / per_day) * 86400 + i % per_day * H).alias("start"))
    draw = lambda salt, low, high: low + F.pmod(F.xxhash64(F.lit(policy.seed), "case_id", F.lit(salt)), F.lit(high - low + 1))
    slower = F.when(F.col("service_group") == "FLOW_B", 3).otherwise(0)
    at, columns = F.col("start"), []
    for j, stage in enumerate(STAGES):
        if j:
            at = at + (draw(f"gap{j}", *((3, 7) if j == 1 else (10, 20))) + slower) * H
        columns.append(F.struct(F.lit(stage).alias("event_type"), at.alias("event"), (at + draw(f"lag{j}", 0, 2) * H).alias("recorded")))
    rows = ids.select("case_id", F.explode(F.array(*columns)).alias("e")).select("case_id", F.col("e.event_type"), F.lit("").alias("suffix"), F.lit(1).alias("revision"), F.lit("UPSERT").alias("operation"), F.col("e.event").alias("event"), F.col("e.recorded").alias("recorded"), F.lit(1).alias("copies"))
    return ids.select("case_id", "service_group", F.col("start").alias("registered")), rows


def synthetic_tables(spark: SparkSession, policy: Policy | None = None) -> tuple[DataFrame, DataFrame]:
    """(catalog, deliveries) as strings, in the declared columns of the contracts.

    Deliveries are numbered densely by recording time and id; a copy shares its
    original's number.
    """
    utc(spark)
    policy = policy or Policy()
    base, base_rows = _routine(spark, policy, "BASE", policy.training_cases, "2025-12-01T00:00:00Z", 2)
    later, later_rows = _routine(spark, policy, "MON", policy.monitoring_cases, "2026-01-16T00:00:00Z", 3)
    named = spark.createDataFrame([(k, "FLOW_A", START) for k in EXPECTED], "case_id string, service_group string, registered bigint")
    rows = spark.createDataFrame(_scenario_rows(), "case_id string, event_type string, suffix string, revision int, operation string, event bigint, recorded bigint, copies int")
    rows = rows.unionByName(base_rows).unionByName(later_rows)
    rows = rows.withColumn("event_id", F.concat("case_id", F.lit("-"), "event_type", "suffix"))
    # Sorted by what is unique: an event's revision is delivered anew only at another time.
    rows = rows.withColumn("delivery_id", F.concat(F.lit("DEL"), F.substring(F.sha2(F.concat_ws("/", "event_id", "revision", "recorded"), 256), 1, 12)))
    rows = rows.withColumn("delivery_seq", F.dense_rank().over(W.orderBy("recorded", "delivery_id")))  # a few hundred rows, by construction
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    marker = F.lit("true").alias("synthetic_record")
    catalog = base.unionByName(later).unionByName(named).select("case_id", "service_group", instant_text(F.col("registered")).alias("registered_at"), marker)
    log = rows.select("delivery_id", F.col("delivery_seq").cast("string").alias("delivery_seq"), "event_id", F.col("revision").cast("string").alias("revision"), "case_id", "event_type", "operation", F.coalesce(instant_text(F.col("event")), F.lit("")).alias("event_time"), instant_text(F.col("recorded")).alias("recorded_at"), marker)
    return catalog, log


def generate(spark: SparkSession, folder: str, policy: Policy | None = None) -> None:
    """Write the synthetic catalog and log as CSV, and what is expected of the scenarios as JSON lines."""
    catalog, log = synthetic_tables(spark, policy)
    write_csv(catalog, f"{folder}/cases", ["case_id"])
    write_csv(log, f"{folder}/events", ["delivery_seq", "delivery_id"])
    truth = [(k, state, sorted(reasons)) for k, (state, reasons) in EXPECTED.items()]
    frame = spark.createDataFrame(truth, "case_id string, expected_state string, expected_reasons array<string>")
    frame.coalesce(1).write.mode("overwrite").json(f"{folder}/scenario_truth")
