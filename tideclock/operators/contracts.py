"""Contract checks of a delivery log and its case catalog, as counts of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tideclock.functions import scalars as S
from tideclock.operators.checkpoint import enforce
from tideclock.operators.ranges import quantile_bounds, range_of
from tideclock.plans.policy import GROUPS, STAGES

CATALOG = ("case_id", "service_group", "registered_at", "synthetic_record")
LOG = ("delivery_id", "delivery_seq", "event_id", "revision", "case_id", "event_type", "operation", "event_time", "recorded_at", "synthetic_record")


def typed_catalog(raw: DataFrame) -> DataFrame:
    return raw.select("case_id", "service_group", S.instant_epoch(F.col("registered_at")).alias("registered_epoch"), "synthetic_record")


def typed_log(raw: DataFrame) -> DataFrame:
    """String deliveries as typed ones. Copies of a delivery are equal rows, so any order among them will do."""
    copies = W.partitionBy("delivery_id").orderBy("delivery_seq", "recorded_at")
    return raw.select(
        "delivery_id",
        S.positive_int(F.col("delivery_seq")).alias("delivery_seq"),
        "event_id",
        S.positive_int(F.col("revision")).alias("revision"),
        "case_id",
        "event_type",
        "operation",
        S.instant_epoch(F.col("event_time")).alias("event_epoch"),
        S.instant_epoch(F.col("recorded_at")).alias("recorded_epoch"),
        "synthetic_record",
        F.row_number().over(copies).cast("long").alias("input_index"),
    )


def _sum(bad: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.coalesce(bad, F.lit(True)).cast("long")), F.lit(0)).alias(name)


def _rows(counted: DataFrame) -> DataFrame:
    return counted.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in counted.columns))).alias("r")).select("r.*")


def conflicts(log: DataFrame, identity: list[str], payload: list[str], rule: str) -> DataFrame:
    """How many identities have more than one payload.

    The payload is digested as a struct, which is never null, so retractions
    without a time count; least and greatest digest differ where payloads do.
    """
    digest = F.xxhash64(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}))
    groups = log.select(*identity, digest.alias("d")).groupBy(*identity).agg(F.min("d").alias("low"), F.max("d").alias("high"))
    return groups.filter("low <> high").agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def sequence_inversions(log: DataFrame, ranges: int = 4096) -> DataFrame:
    """Neighbours in delivery order whose recording times fall; whole ranges are compared by their extremes."""
    bounds = quantile_bounds(log, "delivery_seq", ranges)
    cut = log.withColumn("range", range_of(F.col("delivery_seq"), bounds, dict(log.dtypes)["delivery_seq"]))
    inner = W.partitionBy("range").orderBy("delivery_seq", "recorded_epoch")
    inside = cut.select((F.lag("recorded_epoch").over(inner) > F.col("recorded_epoch")).alias("bad"))
    ends = cut.groupBy("range").agg(F.min_by("recorded_epoch", F.struct("delivery_seq", "recorded_epoch")).alias("first"), F.max_by("recorded_epoch", F.struct("delivery_seq", "recorded_epoch")).alias("last"))
    across = ends.select((F.lag("last").over(W.orderBy("range")) > F.col("first")).alias("bad"))  # of at most ``ranges`` rows
    return inside.unionByName(across).agg(F.count_if("bad").alias("violations")).select(F.lit("sequence_against_recorded").alias("rule"), "violations")


def group_checks(log: DataFrame) -> DataFrame:
    """The identity rules V17 to V22 of a typed log."""
    semantic = ["case_id", "event_type", "operation", "event_epoch"]
    checks = [
        conflicts(log, ["delivery_id"], ["delivery_seq", "event_id", "revision", *semantic, "recorded_epoch"], "delivery_payload_conflict"),
        conflicts(log, ["delivery_seq"], ["delivery_id"], "delivery_seq_conflict"),
        conflicts(log, ["event_id", "revision"], semantic, "version_payload_conflict"),
        conflicts(log, ["event_id"], ["case_id", "event_type"], "event_identity_conflict"),
        sequence_inversions(log),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def check_catalog(raw: DataFrame, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    rules = {
        "bad_case_id": ~S.is_identifier(F.col("case_id")),
        "unknown_service_group": ~F.coalesce(F.col("service_group").isin(*groups), F.lit(False)),
        "bad_registered_at": S.instant_epoch(F.col("registered_at")).isNull(),
        "case_marker": ~F.coalesce(F.col("synthetic_record") == "true", F.lit(False)),
    }
    counted = _rows(raw.agg(*(_sum(v, k) for k, v in rules.items()), (F.count(F.lit(1)) == 0).cast("long").alias("empty_catalog")))
    repeated = raw.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("violations"))
    return counted.unionByName(repeated.select(F.lit("repeated_case_id").alias("rule"), "violations"))


def check_rows(raw: DataFrame, catalog: DataFrame) -> DataFrame:
    """(rule, violations) of the rules that string deliveries keep each for itself, against a typed catalog."""
    known = catalog.select(F.col("case_id").alias("known_case"), "registered_epoch")
    rows = raw.join(known, raw["case_id"] == F.col("known_case"), "left")
    event, recorded = S.instant_epoch(F.col("event_time")), S.instant_epoch(F.col("recorded_at"))
    blank = F.coalesce(F.col("event_time"), F.lit("")) == ""
    rules = {
        "unknown_case": F.col("known_case").isNull(),
        "bad_delivery_id": ~S.is_identifier(F.col("delivery_id")),
        "bad_event_id": ~S.is_identifier(F.col("event_id")),
        "bad_delivery_seq": S.positive_int(F.col("delivery_seq")).isNull(),
        "bad_revision": S.positive_int(F.col("revision")).isNull(),
        "unknown_operation": ~F.coalesce(F.col("operation").isin("UPSERT", "RETRACT"), F.lit(False)),
        "unknown_stage": ~F.coalesce(F.col("event_type").isin(*STAGES), F.lit(False)),
        "retraction_with_time": F.coalesce(F.col("operation") == "RETRACT", F.lit(False)) & ~blank,
        "bad_event_time": F.coalesce(F.col("operation") == "UPSERT", F.lit(False)) & event.isNull(),
        "bad_recorded_at": recorded.isNull(),
        "recorded_before_registration": F.coalesce(recorded < F.col("registered_epoch"), F.lit(False)),
        "event_after_recording": F.coalesce(event > recorded, F.lit(False)),
        "delivery_marker": ~F.coalesce(F.col("synthetic_record") == "true", F.lit(False)),
    }
    return _rows(rows.agg(*(_sum(v, k) for k, v in rules.items()), (F.count(F.lit(1)) == 0).cast("long").alias("empty_log")))


def check_log(raw: DataFrame, catalog: DataFrame) -> DataFrame:
    """(rule, violations) of string deliveries against a typed catalog, by row and by identity."""
    return check_rows(raw, catalog).unionByName(group_checks(typed_log(raw)))


def validate(raw_catalog: DataFrame, raw_log: DataFrame, groups: tuple[str, ...] = GROUPS) -> tuple[DataFrame, DataFrame]:
    """Typed catalog and log; raises if any contract is violated."""
    enforce(check_catalog(raw_catalog, groups))
    catalog = typed_catalog(raw_catalog)
    enforce(check_log(raw_log, catalog))
    return catalog, typed_log(raw_log)
