"""Publication, receipts, strict CSV, the checkpoint audit, the stream and the registry."""

import json
from pathlib import Path
import shutil

import pytest
from pyspark.sql import functions as F

from tideclock.operators import checkpoint as K, contracts
from tideclock.plans import derived, pipeline as P, scenarios, views
from tideclock.plans.policy import Policy, ReplayError
from tideclock.plans.snapshot import evaluate
from tideclock.sources import tables as T
from tideclock.streaming import replay_stream as RS

CASES = [("A1", "2025-Q1", "1", "1", "1", "2", ""), ("A2", "2025-Q1", "1", "0", "0", "0", "1.5"), ("A3", "2025-Q2", "0", "0", "0", "1", "")]
STAGES = [("A1", "1", "1", "x", "1", "2025-01-01", "2025-01-03", "2025-01-05", "2025-01-08", "2025-01-13"), ("A2", "1", "0", "x", "", "", "", "", "", ""), ("A3", "0", "0", "x", "", "", "", "", "", "")]


def csv(path, header, rows):
    path.write_text("\n".join([",".join(header), *(",".join(r) for r in rows)]) + "\n")
    return str(path)


def test_publish_and_verify(spark, tmp_path):
    out = tmp_path / "out"
    facts = P.run(spark, str(out))
    assert facts["status"] == "PASS" and facts["states"] == {"COMPLETE": 102, "OPEN": 2, "REVIEW": 3, "EMPTY": 1} and facts["metadata"]["excluded_future_deliveries"] == 1
    made = T.current(out)
    assert {p.name for p in made.iterdir()} == {*P.INVENTORY, "receipt.json"}
    frozen = json.loads((made / "frozen_baseline.json").read_text())
    assert frozen["training"]["cases"] == 60 and {k: v["count"] for k, v in frozen["profiles"].items()} == {"FLOW_A": 30, "FLOW_B": 30}
    assert spark.read.parquet(str(made / "duration_scores")).select("baseline_hash").distinct().first()[0] == T.digest_of(frozen)
    assert P.verify(spark, str(out))["status"] == "PASS"

    def refused(match, change, seal=True):
        """A false seal over a change: only deriving anew can tell."""
        shutil.rmtree(tmp_path / "spoilt", ignore_errors=True)
        folder = T.current(shutil.copytree(out, tmp_path / "spoilt"))
        change(folder)
        if seal:
            T.seal(folder, P.INVENTORY, {"status": "PASS"})
        with pytest.raises(ReplayError, match=match):
            P.verify(spark, str(tmp_path / "spoilt"))

    def edited(name, **changes):
        return lambda folder: T.write_json(folder / name, json.loads((folder / name).read_text()) | changes)

    def short(folder):
        table = spark.read.parquet(str(made / "review_queue"))
        shutil.rmtree(folder / "review_queue")
        table.limit(17).write.parquet(str(folder / "review_queue"))

    refused("artifacts", lambda folder: (folder / "summary.md").write_text("x"), seal=False)
    refused("inventory", lambda folder: (folder / "summary.md").unlink(), seal=False)
    refused("inventory", lambda folder: (folder / "more.txt").write_text("x"), seal=False)
    refused("software", edited("receipt.json", software={}), seal=False)
    refused("claims", edited("receipt.json", claims={}), seal=False)
    refused("review_queue", short)
    refused("frozen_baseline", edited("frozen_baseline.json", duration_score_threshold=9.0))
    refused("source_manifest", edited("source_manifest.json", policy="0" * 64))


def test_publication_guards(tmp_path):
    ok = lambda folder: (folder.mkdir(), (folder / "a.txt").write_text("a"), T.seal(folder, ["a.txt"], {}))
    home = tmp_path / "a"
    first = T.publish(home, ok)
    assert T.current(home) == first and T.check_receipt(first, ["a.txt"])
    with pytest.raises(ReplayError, match="inventory"):
        T.check_receipt(first, ["a.txt", "b.txt"])

    def broken(folder):
        folder.mkdir()
        raise ValueError("no")

    with pytest.raises(ValueError):
        T.publish(home, broken)
    assert T.current(home) == first and sorted(p.name for p in home.iterdir()) == [T.POINTER, first.name]
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "x").write_text("x")
    (tmp_path / "link").symlink_to(home)
    for bad in (tmp_path / "foreign", tmp_path / "link", tmp_path / "foreign" / "x", Path("/"), Path.cwd()):
        with pytest.raises(RuntimeError):
            T.publish(bad, ok)
    with pytest.raises(ReplayError):
        T.current(tmp_path / "foreign")

    def nested(folder):
        ok(folder)
        with pytest.raises(RuntimeError, match="holds"):
            T.publish(home, ok)

    second = T.publish(home, nested)
    assert T.current(home) == second and first.is_dir()  # who still reads the first may go on
    third = T.publish(home, ok)
    assert T.current(home) == third and not first.exists() and second.is_dir()
    (third / "receipt.json").write_text("{")
    with pytest.raises(ReplayError):
        T.check_receipt(third, ["a.txt"])


def test_strict_csv(spark, tmp_path):
    good = csv(tmp_path / "g.csv", ["b", "a"], [["1", ""], ["", '"x,""y"']])
    assert [tuple(r) for r in T.read_csv(spark, good, ["a", "b"]).orderBy("a").collect()] == [("", "1"), ('x,"y', "")]
    for header, rows in ((["a"], [["1"]]), (["a", "a", "b"], [["1", "2", "3"]]), (["a", "c"], [["1", "2"]]), (["a", "b"], [["1"]]), (["a", "b"], [["1", "2", "3"]])):
        with pytest.raises(ReplayError):
            T.read_csv(spark, csv(tmp_path / "b.csv", header, rows), ["a", "b"])
    lines = T.read_csv(spark, good, ["a", "b"], multiline=False)
    assert lines.count() == 2
    (tmp_path / "folder").mkdir()
    csv(tmp_path / "folder" / "1.csv", ["a", "b"], [["1", "2"]])
    csv(tmp_path / "folder" / "2.csv", ["b", "a"], [["1", "2"]])
    with pytest.raises(Exception, match="header|CSV"):
        T.read_csv(spark, str(tmp_path / "folder"), ["a", "b"]).collect()
    with pytest.raises(ReplayError):
        T.keyed(spark.createDataFrame([("a",), ("a",)], "case_id string"))
    with pytest.raises(ReplayError):
        T.keyed(spark.createDataFrame([(" ",)], "case_id string"))


def test_checkpoint_audit(spark, tmp_path):
    got = P.checkpoint_audit(spark, csv(tmp_path / "c.csv", K.CASES, CASES), csv(tmp_path / "s.csv", K.STAGES, STAGES), str(tmp_path / "audit"))
    assert got["summary"] == {"parent_rows": 3, "primary_rows": 2, "process_rows": 1, "payment_rows": 1, "primary_no_inspection": 1, "primary_single_inspection": 0, "primary_multiple_inspections": 1}
    assert got["clocks"] == [{"decision_period": "2025-Q1", "stage_rows": 1, "flagged_rows": 1, "restricted_rows": 0, "avg_notification_to_decision_days": 10.0}]
    assert got["quality"] == {"checks": 12, "violations": 0, "status": "PASS"} and (tmp_path / "audit" / "index.html").exists()


@pytest.mark.parametrize(
    ("table", "row", "column", "value", "rule"),
    [
        (0, 1, "process_flag", "1", None), (0, 0, "primary_flag", "0", "process_without_primary"), (0, 1, "payment_flag", "1", "payment_without_process"), (0, 0, "inspection_count", "-1", "bad_inspection_count"),
        (0, 0, "reported_delay_days", "inf", "bad_reported_delay_days"), (0, 0, "case_id", " A1", "bad_case_id"), (0, 0, "case_id", "A2", "repeated_case_id"), (0, 0, "primary_flag", "2", "bad_primary_flag"),
        (1, 1, "stage_eligible", "1", "eligible_clock_broken"), (1, 2, "stage_eligible", "1", "eligible_without_primary"), (1, 0, "clock_flag", "", "clock_flag_not_as_eligible"), (1, 1, "clock_flag", "1", "clock_flag_not_as_eligible"),
        (1, 0, "notification_date", "2024-12-31", "eligible_clock_broken"), (1, 0, "visit_date", "", "eligible_clock_broken"),
    ],
)
def test_checkpoint_contracts(spark, tmp_path, table, row, column, value, rule):
    rows, names = [list(map(list, CASES)), list(map(list, STAGES))], [K.CASES, K.STAGES]
    rows[table][row][names[table].index(column)] = value
    paths = [csv(tmp_path / f"{i}.csv", names[i], rows[i]) for i in (0, 1)]
    with pytest.raises(ReplayError, match=rule or "checks failed"):
        P.checkpoint_audit(spark, *paths)


def test_reconciliation(spark):
    cases = spark.createDataFrame([("a", 1, 1), ("b", 1, 0), ("c", 0, 0)], "case_id string, primary_flag int, process_flag int")
    stages = spark.createDataFrame([("a", 0, 1), ("b", 1, 1), ("d", 1, 0)], "case_id string, primary_flag int, stage_eligible int")
    assert K.reconcile(cases, stages).first().asDict() == {"matched": 2, "only_in_cases": 1, "only_in_stages": 1, "primary_disagrees": 1, "stage_without_process": 1}


def test_quality_needs_all_checks(spark):
    assert K.quality_summary(spark.createDataFrame([], "check_name string, violations bigint"))["status"] == "FAIL"


def test_fingerprint(spark, data):
    log = derived.log(spark, data)
    one = T.fingerprint(log).first()
    assert T.fingerprint(log.repartition(9)).first() == one
    assert T.fingerprint(log.unionByName(log.limit(1))).first() != one
    assert T.fingerprint(log.withColumn("revision", F.col("revision") + (F.col("delivery_seq") == 9).cast("int"))).first()["digest"] != one["digest"]
    assert T.fingerprint(log.limit(0)).first()["rows"] == 0


@pytest.mark.parametrize("batches", [1, 5])
def test_stream_equals_batch(spark, data, batches):
    catalog, log = derived.catalog(spark, data), derived.log(spark, data)
    want = RS.snapshot_states(catalog, log, derived.OBSERVED)
    assert T.same_rows(RS.replay_in_batches(catalog, log, derived.OBSERVED, batches), want)


def test_batch_stored_twice_is_stored_once(spark, data, tmp_path):
    log = derived.log(spark, data)
    store = RS.append_batch(str(tmp_path / "log"))
    store(log.limit(10), 0)
    store(log, 0)
    store(log.limit(0), 1)
    assert T.same_rows(RS.stored_log(spark, log.schema, str(tmp_path / "log")), log)


def test_generated_files_read_back(spark, tmp_path):
    scenarios.generate(spark, str(tmp_path))
    catalog = T.read_csv(spark, str(tmp_path / "cases"), contracts.CATALOG)
    log = T.read_csv(spark, str(tmp_path / "events"), contracts.LOG)
    assert (catalog.count(), log.count()) == (108, 540)
    contracts.validate(catalog, log)
    assert spark.read.json(str(tmp_path / "scenario_truth")).count() == 12


def test_views(spark, data):
    catalog, log = derived.catalog(spark, data), derived.log(spark, data)
    names = views.register_replay(catalog, log, evaluate(catalog, log, derived.POLICY))
    assert len(names) == 10 and spark.sql("SELECT count(*) FROM case_clocks WHERE state = 'EMPTY'").first()[0] == 1
    views.register_checkpoint(derived.cases(spark, data), derived.stages(spark, data))
    assert views.read_mart(spark, "quality_results").count() == 12


def test_arguments(tmp_path):
    with pytest.raises(SystemExit):
        P.main(["--output", str(tmp_path), "--as-of", "2026-02-01T00:00:00Z", "--verify-only"])
    assert Policy().with_(observed_at="2026-02-02T00:00:00Z").observed == Policy().observed + 86400
