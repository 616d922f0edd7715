"""The checkpoint audit: typed snapshots, reconciliation, 12 checks and 2 marts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tideclock.functions import scalars as S
from tideclock.plans.policy import ReplayError

CASES = ("case_id", "decision_period", "primary_flag", "process_flag", "payment_flag", "inspection_count", "reported_delay_days")
STAGE_DATES = ("issue_date", "notification_date", "visit_date", "report_date", "decision_date")
STAGES = ("case_id", "primary_flag", "stage_eligible", "second_stage_indicator", "clock_flag", *STAGE_DATES)


def typed_cases(raw: DataFrame) -> DataFrame:
    """String rows as typed rows; what does not parse is null."""
    return raw.select("case_id", "decision_period", *(S.bit(F.col(c)).alias(c) for c in CASES[2:5]), S.nonnegative_int(F.col("inspection_count")).cast("int").alias("inspection_count"), S.finite_real(F.col("reported_delay_days")).alias("reported_delay_days"))


def typed_stages(raw: DataFrame) -> DataFrame:
    return raw.select("case_id", S.bit(F.col("primary_flag")).alias("primary_flag"), S.bit(F.col("stage_eligible")).alias("stage_eligible"), "second_stage_indicator", S.bit(F.col("clock_flag")).alias("clock_flag"), *(S.iso_date(F.col(d)).alias(d) for d in STAGE_DATES))


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def _report(table: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(rule, violations): all row rules in one pass, and the uniqueness of the key."""
    counts = table.agg(*(F.coalesce(F.sum(F.coalesce(bad, F.lit(True)).cast("long")), F.lit(0)).alias(n) for n, bad in rules.items()), (F.count(F.lit(1)) == 0).cast("long").alias("empty_input"))
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in [*rules, "empty_input"]))).alias("r")).select("r.*")
    repeated = table.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("violations"))
    return rows.unionByName(repeated.select(F.lit(f"repeated_{key}").alias("rule"), "violations"))


def check_cases(raw: DataFrame) -> DataFrame:
    """(rule, violations) of a case snapshot read as strings."""
    flag = {c: S.bit(F.col(c)) for c in CASES[2:5]}
    rules = {
        "bad_case_id": ~S.is_trimmed(F.col("case_id")),
        **{f"bad_{c}": v.isNull() for c, v in flag.items()},
        "bad_inspection_count": S.nonnegative_int(F.col("inspection_count")).isNull(),
        "process_without_primary": F.coalesce((flag["process_flag"] == 1) & (flag["primary_flag"] == 0), F.lit(False)),
        "payment_without_process": F.coalesce((flag["payment_flag"] == 1) & (flag["process_flag"] == 0), F.lit(False)),
        "bad_reported_delay_days": ~_blank("reported_delay_days") & S.finite_real(F.col("reported_delay_days")).isNull(),
    }
    return _report(raw, rules, "case_id")


def check_stages(raw: DataFrame) -> DataFrame:
    """(rule, violations) of a stage snapshot read as strings."""
    primary, eligible, clock = (S.bit(F.col(c)) for c in ("primary_flag", "stage_eligible", "clock_flag"))
    dates = [S.iso_date(F.col(d)) for d in STAGE_DATES]
    ordered = reduce(lambda a, b: a & b, [x <= y for x, y in zip(dates, dates[1:], strict=False)])
    present = clock.isNotNull()
    rules = {
        "bad_case_id": ~S.is_trimmed(F.col("case_id")),
        "bad_primary_flag": primary.isNull(),
        "bad_stage_eligible": eligible.isNull(),
        "eligible_without_primary": F.coalesce((eligible == 1) & (primary == 0), F.lit(False)),
        "bad_clock_flag": ~_blank("clock_flag") & ~present,
        "clock_flag_not_as_eligible": F.coalesce(present != (eligible == 1), F.lit(False)),
        "eligible_clock_broken": F.coalesce(eligible == 1, F.lit(False)) & ~F.coalesce(ordered, F.lit(False)),
    }
    return _report(raw, rules, "case_id")


def enforce(report: DataFrame) -> None:
    """Raise if any rule of a report is violated; the report has a row per rule."""
    broken = {r["rule"]: r["violations"] for r in report.filter("violations > 0").collect()}
    if broken:
        raise ReplayError(f"contract violated: {broken}")


def reconcile(cases: DataFrame, stages: DataFrame) -> DataFrame:
    """One row of mismatch counts between the snapshots' keys and flags."""
    left = cases.select("case_id", F.col("primary_flag").alias("p"), "process_flag", F.lit(1).alias("in_cases"))
    right = stages.select("case_id", F.col("primary_flag").alias("q"), "stage_eligible", F.lit(1).alias("in_stages"))
    both = left.join(right, "case_id", "full_outer")
    count = lambda c, name: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(name)
    matched = F.col("in_cases").isNotNull() & F.col("in_stages").isNotNull()
    return both.agg(
        count(matched, "matched"),
        count(F.col("in_stages").isNull(), "only_in_cases"),
        count(F.col("in_cases").isNull(), "only_in_stages"),
        count(matched & (F.col("p") != F.col("q")), "primary_disagrees"),
        count(matched & (F.col("stage_eligible") == 1) & (F.col("process_flag") == 0), "stage_without_process"),
    )


def checkpoint_summary(cases: DataFrame) -> DataFrame:
    """The sample accounting mart; sums over no rows are null, as SQL has them."""
    among = lambda c, name: F.sum(F.when((F.col("primary_flag") == 1) & c, 1).otherwise(0)).alias(name)
    n = F.col("inspection_count")
    return cases.agg(
        F.count(F.lit(1)).alias("parent_rows"),
        F.sum("primary_flag").alias("primary_rows"),
        F.sum("process_flag").alias("process_rows"),
        F.sum("payment_flag").alias("payment_rows"),
        among(n == 0, "primary_no_inspection"),
        among(n == 1, "primary_single_inspection"),
        among(n > 1, "primary_multiple_inspections"),
    )


def process_clock_summary(cases: DataFrame, stages: DataFrame) -> DataFrame:
    """The clock mart by decision period."""
    joined = stages.filter("stage_eligible = 1").select("case_id", "clock_flag", "notification_date", "decision_date").join(cases.select("case_id", "decision_period"), "case_id")
    return joined.groupBy("decision_period").agg(
        F.count(F.lit(1)).alias("stage_rows"),
        F.sum(F.when(F.col("clock_flag") == 1, 1).otherwise(0)).alias("flagged_rows"),
        F.sum(F.when(F.col("clock_flag") == 0, 1).otherwise(0)).alias("restricted_rows"),
        F.round(F.avg(F.datediff("decision_date", "notification_date")), 2).alias("avg_notification_to_decision_days"),
    )


def clock_audit(stages: DataFrame) -> DataFrame:
    """(eligible, flagged, restricted) over eligible stages."""
    return stages.filter("stage_eligible = 1").agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col("clock_flag") == 1).alias("flagged"), F.count_if(F.col("clock_flag") == 0).alias("restricted"))


def quality_results(cases: DataFrame, stages: DataFrame) -> DataFrame:
    """(check_name, violations) of the 12 checks, from one full join of both snapshots and one pass over it.

    Row checks and join checks are conditions on the joined rows, which the
    uniqueness of both keys allows: a row of a snapshot occurs once.
    """
    c = cases.select("case_id", *(F.col(x).alias(f"c_{x}") for x in CASES[2:5]), F.lit(1).alias("in_c"))
    s = stages.select("case_id", F.col("primary_flag").alias("s_primary"), "stage_eligible", "clock_flag", *STAGE_DATES, F.lit(1).alias("in_s"))
    both = c.join(s, "case_id", "full_outer")
    in_c, in_s, eligible = F.col("in_c").isNotNull(), F.col("in_s").isNotNull(), F.col("stage_eligible") == 1
    dates = [F.col(d) for d in STAGE_DATES]
    ordered = reduce(lambda a, b: a & b, [x <= y for x, y in zip(dates, dates[1:], strict=False)])
    conditions = {
        "stage_key_coverage": in_c & ~in_s,
        "no_orphan_stages": in_s & ~in_c,
        "primary_indicator_agreement": F.col("c_primary_flag") != F.col("s_primary"),
        "process_requires_primary": (F.col("c_process_flag") == 1) & (F.col("c_primary_flag") == 0),
        "payment_requires_process": (F.col("c_payment_flag") == 1) & (F.col("c_process_flag") == 0),
        "stage_requires_process": eligible & (F.col("c_process_flag") == 0),
        "eligible_clock_flag_required": eligible & F.col("clock_flag").isNull(),
        "nonstage_clock_flag_blank": (F.col("stage_eligible") == 0) & F.col("clock_flag").isNotNull(),
        "eligible_clock_complete": eligible & reduce(lambda a, b: a | b, [d.isNull() for d in dates]),
        "chronology_ordered": eligible & ~ordered,
    }
    totals = {
        "process_stage_count_reconciles": F.sum("c_process_flag") == F.sum("stage_eligible"),
        "clock_partition_reconciles": F.count_if(eligible) == F.count_if(eligible & F.col("clock_flag").isin(0, 1)),
    }
    counts = [F.count_if(v).alias(k) for k, v in conditions.items()]
    counts += [F.when(v, F.lit(0)).otherwise(F.lit(1)).cast("long").alias(k) for k, v in totals.items()]
    made = both.agg(*counts)
    return made.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check_name"), F.col(k).alias("violations")) for k in [*conditions, *totals]))).alias("r")).select("r.*")


def quality_summary(results: DataFrame) -> dict:
    """Sum of violations and PASS or FAIL; all 12 checks must be there."""
    row = results.agg(F.count(F.lit(1)), F.sum("violations")).first()
    return {"checks": row[0], "violations": row[1], "status": "PASS" if row[0] == 12 and row[1] == 0 else "FAIL"}
