"""Results as temporary views, for clients that speak SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideclock.operators import checkpoint as K
from tideclock.plans.snapshot import Results

CHECKPOINT = ("checkpoint_cases", "checkpoint_stages", "quality_results", "mart_checkpoint_summary", "mart_process_clock_summary")


def register_checkpoint(cases: DataFrame, stages: DataFrame) -> tuple[str, ...]:
    """Typed snapshots, checks and marts as views; they are computed when they are read."""
    tables = (cases, stages, K.quality_results(cases, stages), K.checkpoint_summary(cases), K.process_clock_summary(cases, stages))
    for name, table in zip(CHECKPOINT, tables, strict=True):
        table.createOrReplaceTempView(name)
    return CHECKPOINT


def register_replay(catalog: DataFrame, log: DataFrame, results: Results) -> tuple[str, ...]:
    """The typed inputs and every table of a replay as views."""
    snap = results.snapshot
    tables = {
        "case_catalog": catalog, "raw_events": log, "ingest_audit": snap.audit, "effective_events": snap.effective, "case_clocks": snap.clocks, "stage_durations": snap.durations,
        "baseline_members": results.members, "baseline_profiles": results.profiles, "duration_scores": results.scores, "review_queue": results.queue,
    }
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    return tuple(tables)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose key is not in ``parent``: a foreign key check."""
    return child.join(parent.select(key), key, "left_anti")


def read_mart(spark: SparkSession, name: str, order: str | None = None) -> DataFrame:
    table = spark.table(name)
    return table.orderBy(order) if order else table
