"""The registered queries on the driver's tables, one per operator family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideclock.functions import scalars
from tideclock.operators import checkpoint as K, clocks as C, contracts, replay as R, scores as S
from tideclock.plans import derived as D, gates as G, scenarios, views
from tideclock.plans.snapshot import Results, baseline, classified, evaluate, parameters
from tideclock.sources import tables

P = D.POLICY


def _round(table: DataFrame, *columns: str) -> DataFrame:
    return table.withColumns({c: F.round(c, 6) for c in columns})


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.classify(D.log(spark, sf_dir), D.OBSERVED)


def _clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.case_clocks(D.catalog(spark, sf_dir), _actions(spark, sf_dir), D.OBSERVED)


def _results(spark: SparkSession, sf_dir: str) -> Results:
    return evaluate(D.catalog(spark, sf_dir), D.log(spark, sf_dir), P)


def asof_delivery_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = R.arrived(D.log(spark, sf_dir), D.OBSERVED)
    return log.groupBy("case_id").agg(F.count(F.lit(1)).alias("deliveries"), F.max("recorded_epoch").alias("last_recorded"))


def ingest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _actions(spark, sf_dir).select("delivery_id", "input_index", "event_id", "revision", "case_id", "operation", "action")


def action_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _actions(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def watermark_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = R.with_watermark(classified(D.log(spark, sf_dir), D.OBSERVED), P.lateness)
    return audit.select("ingest_index", "delivery_id", "action", "probe_epoch", "watermark_before", "watermark_after", "late_update", "case_revision")


def snapshot_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.snapshot_metadata(R.with_watermark(classified(D.log(spark, sf_dir), D.OBSERVED), P.lateness), D.log(spark, sf_dir))


def effective_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.effective(_actions(spark, sf_dir)).select("event_id", "revision", "case_id", "event_type", "operation", "event_epoch", "delivery_id")


def live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.live(_actions(spark, sf_dir)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_epoch").alias("first_epoch"), F.max("event_epoch").alias("last_epoch"))


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stage_counts(_actions(spark, sf_dir))


def case_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clocks(spark, sf_dir).groupBy("service_group", "state").agg(F.count(F.lit(1)).alias("cases"))


def case_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = ["issue_to_decision_hours", "notification_to_decision_hours", "issue_age_hours", "notification_age_hours"]
    return _round(_clocks(spark, sf_dir).select("case_id", "service_group", "state", "projection_revision", "issue_epoch", "notification_epoch", "decision_epoch", "decision_retracted", *hours), *hours)


def issue_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clocks(spark, sf_dir).select("case_id", F.array_join("issues", ",").alias("issues"))


def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(C.stage_durations(_clocks(spark, sf_dir)), "duration_hours")


def clock_partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    clocks = _clocks(spark, sf_dir)
    off = C.partition_check(clocks, C.stage_durations(clocks))
    return off.agg(F.count(F.lit(1)).alias("violations"))


def robust_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = baseline(D.catalog(spark, sf_dir), D.log(spark, sf_dir), P)
    return _round(found, "log_median", "log_mad", "scale")


def duration_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_results(spark, sf_dir).scores.drop("baseline_hash"), "duration_hours", "log_duration", "baseline_median", "baseline_scale", "upper_tail_score")


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).queue.select("alert_id", "case_id", "service_group", "priority", "category", "reason", "status", "establishes_legal_breach", "establishes_wrongdoing")


def queue_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of every candidate as its JSON text; where that holds a measured number, the number instead."""
    queue = _results(spark, sf_dir).queue
    measured = F.coalesce(*(F.get_json_object("evidence_json", f"$.{k}").cast("double") for k in ("age_hours", "upper_tail_score")))
    return queue.select("case_id", "reason", F.when(measured.isNull(), F.col("evidence_json")).alias("evidence"), F.round(measured, 6).alias("measured"))


def baseline_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen baseline document, a row for each profile, and whether all scores bear its digest."""
    results = _results(spark, sf_dir)
    made = results.document
    rows = [(g, p["count"], p["log_median"], p["log_mad"], p["scale"], made["training"]["cases"], float(made["mad_scale_floor"]), float(made["duration_score_threshold"]), made["baseline_cutoff"]) for g, p in made["profiles"].items()]
    kinds = "service_group string, count bigint, log_median double, log_mad double, scale double, training_cases bigint, mad_scale_floor double, duration_score_threshold double, baseline_cutoff string"
    borne = results.scores.agg(F.coalesce(F.bool_and(F.col("baseline_hash") == tables.digest_of(made)), F.lit(False)).alias("scores_bear_its_hash"))
    return _round(spark.createDataFrame(rows, kinds), "log_median", "log_mad", "scale").crossJoin(F.broadcast(borne))  # one row


def queue_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).queue.groupBy("priority", "category", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(scalars.is_json(F.col("evidence_json"))).alias("valid_json"))


def contract_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity rules over the log with a changed payload, stage, number and time planted on some rows."""
    k = F.pmod("delivery_seq", F.lit(1000))
    copy = F.pmod("input_index", F.lit(2)) == 1
    dirty = D.log(spark, sf_dir).withColumns({
        "delivery_id": F.when(copy & (k % 3 == 0), -F.col("delivery_id")).otherwise(F.col("delivery_id")),
        "recorded_epoch": F.when(k == 7, F.col("recorded_epoch") - 864000).otherwise(F.col("recorded_epoch")),
        "event_type": F.when(k == 11, "DECIDED").otherwise(F.col("event_type")),
        "event_epoch": F.when(copy & (k % 3 == 1), F.col("event_epoch") - 1).otherwise(F.col("event_epoch")),
    })
    return contracts.group_checks(dirty)


def log_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row rules over the log as string deliveries, with a fault of each kind planted on some."""
    k = F.pmod("delivery_seq", F.lit(1000))
    either = lambda column, faults: reduce(lambda made, fault: F.when(k == fault[0], F.lit(fault[1])).otherwise(made), faults.items(), column)
    instant = lambda epoch: F.coalesce(scalars.instant_text(F.col(epoch)), F.lit(""))
    raw = D.log(spark, sf_dir).select(
        either(F.concat(F.lit("D"), "delivery_id"), {2: " d"}).alias("delivery_id"),
        either(F.col("delivery_seq").cast("string"), {4: "x1", 14: "0"}).alias("delivery_seq"),
        either(F.concat(F.lit("E"), "event_id"), {3: ""}).alias("event_id"),
        either(F.col("revision").cast("string"), {5: "0"}).alias("revision"),
        either(F.concat(F.lit("C"), "case_id"), {1: "C-none"}).alias("case_id"),
        either(F.col("event_type"), {7: "OTHER"}).alias("event_type"),
        either(F.col("operation"), {6: "DELETE", 8: "RETRACT", 9: "UPSERT"}).alias("operation"),
        either(instant("event_epoch"), {8: "2024-01-01T00:00:00Z", 9: "never", 12: "2030-01-01T01:00:00+01:00"}).alias("event_time"),
        either(instant("recorded_epoch"), {10: "2024-01-02 00:00:00", 11: "2000-01-01T00:00:00Z"}).alias("recorded_at"),
        either(F.lit("true"), {13: "false"}).alias("synthetic_record"),
    )
    catalog = D.catalog(spark, sf_dir).withColumn("case_id", F.concat(F.lit("C"), "case_id"))
    return contracts.check_rows(raw, catalog)


def catalog_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the catalog, with a fault of each kind planted and some cases repeated."""
    k = F.pmod("case_id", F.lit(100))
    catalog = D.catalog(spark, sf_dir)
    twice = catalog.unionByName(catalog.filter(k == 5))
    raw = twice.select(
        F.concat(F.when(k == 1, "C ").otherwise("C"), "case_id").alias("case_id"),
        F.when(k == 2, "FLOW_X").otherwise(F.col("service_group")).alias("service_group"),
        F.when(k == 3, "yesterday").otherwise(scalars.instant_text(F.col("registered_epoch"))).alias("registered_at"),
        F.when(k == 4, "no").otherwise("true").alias("synthetic_record"),
    )
    return contracts.check_catalog(raw)


def param_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = D.log(spark, sf_dir).filter(F.col("recorded_epoch") <= D.OBSERVED)
    both = log.crossJoin(F.broadcast(parameters(P, spark))).filter("recorded_epoch <= as_of")  # two rows
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("deliveries"), F.countDistinct("case_id").alias("cases"))


def checkpoint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.checkpoint_summary(D.cases(spark, sf_dir))


def checkpoint_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.quality_results(D.cases(spark, sf_dir), D.stages(spark, sf_dir))


def process_clock_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.process_clock_summary(D.cases(spark, sf_dir), D.stages(spark, sf_dir))


def clock_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.clock_audit(D.stages(spark, sf_dir))


def key_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.reconcile(D.cases(spark, sf_dir), D.stages(spark, sf_dir))


def checkpoint_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row rules over the derived snapshots, written as strings; some break them."""
    as_text = lambda t: t.select(*(F.col(c).cast("string").alias(c) for c in t.columns))
    cases = as_text(D.cases(spark, sf_dir).withColumn("reported_delay_days", F.when(F.col("case_id") % 50 == 1, "nan").when(F.col("case_id") % 50 == 2, "").otherwise("1.5")))
    stages = as_text(D.stages(spark, sf_dir).withColumn("second_stage_indicator", F.lit("x")))
    left = K.check_cases(cases).withColumn("snapshot", F.lit("cases"))
    return left.unionByName(K.check_stages(stages).withColumn("snapshot", F.lit("stages")))


def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants of the events written with offsets up to 23:59 and read back."""
    events = scalars.utc(spark).read.parquet(f"{sf_dir}/events.parquet")
    minutes = F.pmod("event_id", F.lit(2879)) - 1439
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    size = F.abs(minutes)
    text = F.concat(F.date_format(F.timestamp_seconds(epoch + minutes * 60), "yyyy-MM-dd'T'HH:mm:ss"), F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))
    back = scalars.instant_epoch(text)
    return events.select("event_id", back.alias("epoch"), scalars.instant_text(back).alias("instant"))


def gate_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    marker = F.lit("true")
    catalog, log = D.catalog(spark, sf_dir), D.log(spark, sf_dir)
    results = evaluate(catalog, log, P)
    return G.gates(catalog.withColumn("synthetic_record", marker), log.withColumn("synthetic_record", marker), results, P)


def gate_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates over tables with planted faults: what each must count follows from the tables."""
    marker = F.lit("true")
    catalog, log = D.catalog(spark, sf_dir).withColumn("synthetic_record", marker), D.log(spark, sf_dir).withColumn("synthetic_record", marker)
    results = evaluate(catalog, log, P)
    judged = {name: tables.materialize(t, name) for name, t in G.judged_tables(results).items()}
    made = G.expected_tables(catalog, log, judged["audit"], P) | judged
    every = lambda column, n, rest: F.pmod(column, F.lit(n)) == rest
    change = lambda name, where, column, value: made[name].withColumn(column, F.when(where, value).otherwise(F.col(column)))
    faults = {
        "E01": {"catalog": made["catalog"].unionByName(made["catalog"].filter(every("case_id", 50, 1)))},
        "E02": {"log": change("log", every("delivery_seq", 50, 3), "synthetic_record", F.lit("x"))},
        "E04": {"log": change("log", every("delivery_seq", 50, 4), "event_type", F.lit("OTHER"))},
        "E07": {"audit": change("audit", every("delivery_seq", 50, 5), "action", F.lit("unheard of"))},
        "E11": {"effective": change("effective", every("event_id", 40, 10), "revision", F.col("revision") + 1)},
        "E13": {"clocks": change("clocks", every("case_id", 30, 1), "state", F.lit("LOST"))},
        "E15": {"clocks": change("clocks", every("case_id", 7, 1), "issue_to_decision_hours", F.col("issue_to_decision_hours") + 1)},
        "E17": {"durations": made["durations"].filter(~every("case_id", 7, 2))},
        "E20": {"members": made["members"].filter(~every("case_id", 3, 1))},
        "E22": {"scores": made["scores"].filter(~every("case_id", 5, 1))},
        "E24": {"queue": change("queue", every("case_id", 6, 1), "status", F.lit("settled"))},
        "E25": {"queue": made["queue"].filter("reason <> 'aged_open_case'")},
        "E26": {"queue": change("queue", every("case_id", 6, 2) & (F.col("reason") != "aged_open_case"), "evidence_json", F.lit("{"))},
    }
    names = {n[:3]: n for n in G.gate_queries(P)}
    return reduce(DataFrame.unionByName, [G.compare(made | fault, P, [names[gate]]) for gate, fault in faults.items()])


def source_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's digest, of the log as it lies and dealt anew."""
    log = R.arrived(D.log(spark, sf_dir), D.OBSERVED)
    return tables.fingerprint(log).withColumn("order_of_rows", F.lit("as stored")).unionByName(tables.fingerprint(log.repartition(7, "input_index")).withColumn("order_of_rows", F.lit("dealt")))


def scenario_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review queue of the labelled scenarios under the published policy."""
    from tideclock.plans.policy import Policy

    catalog, log = scenarios.synthetic_tables(spark)
    typed = contracts.typed_catalog(catalog), contracts.typed_log(log)
    return evaluate(*typed, Policy()).queue.select("alert_id", "case_id", "priority", "category", "reason")


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effective versions, written as CSV to the scratch folder and read back strictly."""
    from tideclock.sources.tables import scratch_folder

    folder = scratch_folder(spark, "csv")
    out = effective_versions(spark, sf_dir)
    tables.write_csv(out, folder, ["event_id"])
    back = tables.read_csv(spark, folder, out.columns)
    return back.select(*(F.nullif(F.col(c), F.lit("")).try_cast(t).alias(c) for c, t in out.dtypes))


def mart_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.register_checkpoint(D.cases(spark, sf_dir), D.stages(spark, sf_dir))
    return views.read_mart(spark, "mart_process_clock_summary", "decision_period")


def orphan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages without a case, and cases without stages, by quarter of the key."""
    cases, stages = D.cases(spark, sf_dir), D.stages(spark, sf_dir)
    left = views.orphans(stages, cases, "case_id").select("case_id", F.lit("no case").alias("problem"))
    right = views.orphans(cases, stages, "case_id").select("case_id", F.lit("no stages").alias("problem"))
    return left.unionByName(right)


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideclock.streaming.replay_stream import replay_in_batches

    return replay_in_batches(D.catalog(spark, sf_dir), D.log(spark, sf_dir), D.OBSERVED, 4)


QUERIES = {
    f.__name__: f
    for f in (
        asof_delivery_filter, ingest_actions, action_histogram, watermark_audit, snapshot_metadata, effective_versions, live_events,
        stage_counts, case_states, case_clocks, issue_flags, stage_durations, clock_partition_check, robust_profiles, duration_scores,
        review_queue, queue_by_reason, queue_evidence, baseline_document, contract_conflicts, log_contract, catalog_contract, param_cross_join, checkpoint_summary, checkpoint_quality, process_clock_mart,
        clock_audit, mart_scan, orphan_lines, key_reconciliation, checkpoint_contract, instants, gate_suite, gate_faults, source_fingerprint, scenario_queue, csv_roundtrip, stream_replay,
    )
}
