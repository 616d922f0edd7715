"""As-of replay of an append-only delivery log.

A log has delivery_id, delivery_seq, event_id, revision, case_id, event_type,
operation, event_epoch (null for a retraction), recorded_epoch and input_index
(a tiebreak among copies of one delivery). One shuffle by case serves every
window and every aggregate of a case, since a case is fixed by its event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tideclock.operators.ranges import quantile_bounds, range_of

#: Ranges into which the sequence is cut for the running watermark; their table is broadcast.
RANGES = 4096


def arrived(log: DataFrame, as_of: int) -> DataFrame:
    """Deliveries recorded by an instant; a literal, so that it reaches the scan."""
    return log.filter(F.col("recorded_epoch") <= F.lit(as_of))


def classify(log: DataFrame, as_of: int) -> DataFrame:
    """Adds action, probe_epoch (what lateness is judged by), latest and case_revision.

    No running state is needed: the highest revision among the rows before is
    the highest accepted one, as a row that raises it is accepted. Copies of a
    delivery share its sequence number and so stand next to each other.
    """
    event = W.partitionBy("case_id", "event_id").orderBy("delivery_seq", "input_index")
    version = W.partitionBy("case_id", "event_id", "revision").orderBy("delivery_seq", "input_index")
    before = event.rowsBetween(W.unboundedPreceding, -1)
    seen = arrived(log, as_of).repartition("case_id")
    seen = seen.withColumn("again", F.row_number().over(version) > 1)
    seen = seen.withColumn("action", F.when(F.lag("delivery_seq").over(event) == F.col("delivery_seq"), "duplicate_delivery").when(F.col("again"), "duplicate_version").when(F.max("revision").over(before) > F.col("revision"), "stale_revision").otherwise("accepted"))
    accepted = F.col("action") == "accepted"
    # The last accepted version may be a tombstone without a time, so a struct is carried and not the time.
    previous = F.last(F.when(accepted, F.struct("event_epoch")), ignorenulls=True).over(before)
    seen = seen.withColumn("probe_epoch", F.when(F.col("operation") == "UPSERT", F.col("event_epoch")).otherwise(previous["event_epoch"]))
    # Accepted revisions only rise, so the latest version is the accepted row that no accepted row follows.
    after = event.rowsBetween(1, W.unboundedFollowing)
    seen = seen.withColumn("latest", accepted & (F.coalesce(F.max(accepted).over(after), F.lit(False)) == F.lit(False)))
    case = W.partitionBy("case_id").orderBy("delivery_seq", "input_index").rowsBetween(W.unboundedPreceding, 0)
    return seen.withColumn("case_revision", F.sum(accepted.cast("long")).over(case)).drop("again")


def with_watermark(actions: DataFrame, lateness: int) -> DataFrame:
    """Adds ingest_index, watermark_before, watermark_after and late_update.

    The sequence is cut into RANGES ranges of about equally many rows. Counts
    and maxima of whole ranges are carried over a table of that fixed size;
    inside a range a window of its own runs. No task ever orders the whole log.
    ``actions`` is read several times and should be written down before.
    """
    bounds = quantile_bounds(actions, "delivery_seq", RANGES)
    cut = actions.withColumn("range", range_of(F.col("delivery_seq"), bounds, dict(actions.dtypes)["delivery_seq"]))
    moves: Column = F.when((F.col("action") == "accepted") & (F.col("operation") == "UPSERT"), F.col("event_epoch"))
    whole = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    carried = cut.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.max(moves).alias("top"))
    carried = carried.select("range", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("rows_before"), F.max("top").over(whole).alias("top_before"))
    inner = W.partitionBy("range").orderBy("delivery_seq", "input_index")
    joined = cut.join(F.broadcast(carried), "range")
    before = F.greatest("top_before", F.max(moves).over(inner.rowsBetween(W.unboundedPreceding, -1)))
    after = F.greatest("top_before", F.max(moves).over(inner.rowsBetween(W.unboundedPreceding, 0)))
    marked = joined.select(
        *actions.columns,
        (F.col("rows_before") + F.row_number().over(inner)).cast("long").alias("ingest_index"),
        (before - lateness).alias("watermark_before"),
        (after - lateness).alias("watermark_after"),
    )
    late = (F.col("action") == "accepted") & (F.col("probe_epoch") < F.col("watermark_before"))
    return marked.withColumn("late_update", F.coalesce(late, F.lit(False)).cast("int"))


def effective(actions: DataFrame) -> DataFrame:
    """The latest version of each event, tombstones included."""
    return actions.filter("latest").select("event_id", "revision", "case_id", "event_type", "operation", "event_epoch", "delivery_id", "delivery_seq", "recorded_epoch")


def live(actions: DataFrame) -> DataFrame:
    return effective(actions).filter("operation = 'UPSERT'")


def snapshot_metadata(audit: DataFrame, log: DataFrame) -> DataFrame:
    """One row of counts over an audited snapshot."""
    is_ = lambda action: F.coalesce(F.sum((F.col("action") == action).cast("long")), F.lit(0)).alias(action)
    total = log.agg(F.count(F.lit(1)).alias("total"))
    counted = audit.agg(
        F.count(F.lit(1)).alias("consumed_deliveries"),
        *(is_(a) for a in ("accepted", "duplicate_delivery", "duplicate_version", "stale_revision")),
        F.coalesce(F.sum(F.col("latest").cast("long")), F.lit(0)).alias("effective_event_versions"),
        F.coalesce(F.sum((F.col("latest") & (F.col("operation") == "UPSERT")).cast("long")), F.lit(0)).alias("active_events"),
        F.coalesce(F.sum(F.col("late_update").cast("long")), F.lit(0)).alias("late_updates"),
        F.max("watermark_after").alias("final_watermark"),
    )
    return counted.crossJoin(F.broadcast(total)).withColumn("excluded_future_deliveries", F.col("total") - F.col("consumed_deliveries")).drop("total")
