"""A delivery log and checkpoint snapshots derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from tideclock.functions.scalars import utc
from tideclock.plans.policy import STAGES, Policy, instant

# Fixed values of the derivation.
E0 = 1704067200  # 2024-01-01T00:00:00Z
PERIOD = 259200
OBSERVED_AT = "2024-01-29T12:00:00Z"
BASELINE_CUTOFF = "2024-01-15T00:00:00Z"
OBSERVED, CUTOFF = instant(OBSERVED_AT), instant(BASELINE_CUTOFF)

POLICY = Policy(observed_at=OBSERVED_AT, baseline_cutoff=BASELINE_CUTOFF, minimum_baseline_cases=3, duration_score_threshold=1.0, absolute_duration_hours=36)


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, recorded_epoch, k, case_id) of the driver's events."""
    events = utc(spark).read.parquet(f"{sf_dir}/events.parquet")
    recorded = F.unix_seconds(F.col("ts").cast("timestamp"))
    return events.select(
        (F.col("event_id") + 1).alias("seq"),
        recorded.alias("recorded_epoch"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("user_id") * 100 + F.floor((recorded - E0) / PERIOD)).alias("case_id"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of the derived log; windows share the one shuffle by case."""
    k = F.col("k")
    rows = source(spark, sf_dir).repartition("case_id")
    rows = rows.withColumn("rn", F.row_number().over(W.partitionBy("case_id").orderBy("seq")))
    rows = rows.withColumn("stage", F.pmod(F.col("rn") - 1, F.lit(5)) + 1).withColumn("cycle", F.floor((F.col("rn") - 1) / 5) + 1)
    rows = rows.withColumn("event_id", F.col("case_id") * 100 + F.col("stage") * 10 + (k % 29 == 0).cast("int"))
    rows = rows.withColumn("revision", F.col("cycle") + F.when(k % 13 == 0, 2).otherwise(0) - F.when((k % 11 == 0) & (F.col("cycle") > 1), 1).otherwise(0))
    own = F.struct(
        F.when((k % 19 == 0) & (F.col("cycle") > 1), "RETRACT").otherwise("UPSERT").alias("operation"),
        (F.col("recorded_epoch") - F.when(k % 23 == 0, 108000).otherwise(0) - 7200 * (F.col("cycle") - 1)).alias("at"),
    )
    first = F.first(own).over(W.partitionBy("case_id", "event_id", "revision").orderBy("seq"))
    rows = rows.withColumn("first", first)
    copies = F.explode(F.when(k % 37 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    rows = rows.select("*", copies)
    return rows.select(
        F.col("seq").alias("delivery_id"),
        F.col("seq").alias("delivery_seq"),
        "event_id",
        "revision",
        "case_id",
        F.element_at(F.array(*(F.lit(s) for s in STAGES)), F.col("stage").cast("int")).alias("event_type"),
        F.col("first.operation").alias("operation"),
        F.when(F.col("first.operation") == "UPSERT", F.col("first.at")).alias("event_epoch"),
        "recorded_epoch",
        (F.col("seq") * 2 + F.col("copy")).alias("input_index"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = source(spark, sf_dir).select("case_id").distinct()
    return cases.select("case_id", F.when(F.floor(F.col("case_id") / 100) % 2 == 0, "FLOW_A").otherwise("FLOW_B").alias("service_group"), (F.lit(E0) + F.pmod("case_id", F.lit(100)) * PERIOD).alias("registered_epoch"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as checkpoint cases."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    date = F.col("o_orderdate").cast("date")
    primary = F.col("o_orderstatus").isin("F", "O")
    return orders.select(
        F.col("o_orderkey").alias("case_id"),
        F.concat(F.year(date).cast("string"), F.lit("-Q"), F.quarter(date).cast("string")).alias("decision_period"),
        primary.cast("int").alias("primary_flag"),
        (F.col("o_orderstatus") == "F").cast("int").alias("process_flag"),
        F.col("o_orderpriority").startswith("1").cast("int").alias("payment_flag"),
        F.pmod("o_orderkey", F.lit(4)).cast("int").alias("inspection_count"),
    )


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, summed by order, as checkpoint stages; dirty on purpose."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("ship"), "l_quantity")
    made = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("ship").alias("low"), F.max("ship").alias("high"), F.min("l_linenumber").alias("line"))
    key, n = F.col("l_orderkey"), F.col("n")
    eligible = key % 3 == 0
    return made.select(
        key.alias("case_id"),
        F.when(key % 7 == 0, 0).otherwise(1).alias("primary_flag"),
        eligible.cast("int").alias("stage_eligible"),
        F.when(eligible & (key % 5 != 0), (n > 3).cast("int")).when(key % 11 == 0, 1).alias("clock_flag"),
        F.col("low").alias("issue_date"),
        F.date_add("low", F.col("line").cast("int")).alias("notification_date"),
        F.when(key % 13 != 0, F.date_add("low", n.cast("int"))).alias("visit_date"),
        F.col("high").alias("report_date"),
        F.date_add("high", 3).alias("decision_date"),
    )
