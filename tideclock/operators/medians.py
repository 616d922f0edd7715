"""Exact medians of large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from tideclock.operators.ranges import ACCURACY


def exact_medians(table: DataFrame, group: str, value: str) -> DataFrame:
    """(group, count, median) of non-null values; the mean of the two middle ones where their number is even.

    A sketch gives two values between which the middle must lie. The values
    below are counted, and only those in between, a few in ten thousand and
    with their repeats counted, are put in order. ``group`` has few values; their
    table is broadcast.
    """
    given = table.select(group, value).filter(F.col(value).isNotNull())
    slack = 2 / ACCURACY
    ends = given.groupBy(group).agg(F.count(F.lit(1)).alias("count"), F.percentile_approx(value, F.array(F.lit(0.5 - slack), F.lit(0.5 + slack)), ACCURACY).alias("ends"))
    met = given.join(F.broadcast(ends), group)
    spread = met.groupBy(group, F.when(F.col(value) < F.col("ends")[0], F.lit(None)).otherwise(F.col(value)).alias("at")).agg(F.first("count").alias("count"), F.first("ends").alias("ends"), F.count(F.lit(1)).alias("n"))
    near = spread.filter(F.col("at").isNull() | (F.col("at") <= F.col("ends")[1]))
    up_to = F.sum("n").over(W.partitionBy(group).orderBy(F.col("at").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    ranked = near.withColumn("up_to", up_to)
    at = lambda rank: F.min(F.when(F.col("up_to") >= rank, F.coalesce("at", F.raise_error(F.lit("a median below its sketch")))))
    half = F.floor((F.col("count") + 1) / 2)
    return ranked.groupBy(group).agg(F.first("count").alias("count"), ((at(half) + at(F.floor(F.col("count") / 2) + 1)) / 2).alias("median"))
