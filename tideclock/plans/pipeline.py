"""Build, publish and verify the replay artifacts, and run the checkpoint audit."""

from __future__ import annotations

import argparse
import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideclock.functions.scalars import utc
from tideclock.operators import checkpoint as K, contracts, replay as R
from tideclock.plans import gates as G, scenarios
from tideclock.plans.policy import Policy, ReplayError, load_policy, parse_policy
from tideclock.plans.snapshot import Results, evaluate
from tideclock.sources import tables as T

#: Artifact -> sort order.
ARTIFACTS = {"ingest_audit": ["ingest_index"], "effective_events": ["event_id"], "case_clocks": ["case_id"], "stage_durations": ["case_id", "from_stage"], "duration_scores": ["case_id"], "review_queue": ["priority", "case_id", "reason"]}

#: Everything that a publication holds beside its receipt.
INVENTORY = (*ARTIFACTS, "input_cases", "input_events", "baseline_members", "frozen_baseline.json", "source_manifest.json", "policy.json", "gates.json", "summary.json", "summary.md", "index.html")


def artifacts(results: Results) -> dict[str, DataFrame]:
    snap = results.snapshot
    return {"ingest_audit": snap.audit, "effective_events": snap.effective, "case_clocks": snap.clocks, "stage_durations": snap.durations, "duration_scores": results.scores, "review_queue": results.queue}


def manifest(log: DataFrame, policy: Policy, results: Results) -> dict:
    """Digests of what a run was made from: all deliveries, those of each snapshot, policy and baseline."""
    prints = {"source": log, "observed_source": R.arrived(log, policy.observed), "baseline_source": R.arrived(log, policy.cutoff)}
    made = {name: T.fingerprint(table).first().asDict() for name, table in prints.items()}
    return {"protocol": policy.protocol, **made, "policy": T.digest_of(json.loads(policy.to_json())), "baseline": T.digest_of(results.document)}


def summary(results: Results, log: DataFrame, gate_rows: list[dict]) -> dict:
    """The facts of a run, from small aggregates."""
    snap = results.snapshot
    meta = R.snapshot_metadata(snap.audit, log).first().asDict()
    states = {r["state"]: r["count"] for r in snap.clocks.groupBy("state").count().collect()}
    reasons = {r["reason"]: r["count"] for r in results.queue.groupBy("reason").count().collect()}
    scored = results.scores.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("flagged"), F.lit(0)).alias("flagged")).first()
    failures = sum(g["failures"] for g in gate_rows)
    return {"metadata": meta, "states": states, "reasons": reasons, "scored": scored["n"], "flagged": scored["flagged"], "gates": len(gate_rows), "gate_failures": failures, "status": "PASS" if len(gate_rows) == 26 and not failures else "FAIL"}


def markdown(facts: dict) -> str:
    lines = ["# Replay summary", "", f"Gates: {facts['gates']}, failures {facts['gate_failures']}: {facts['status']}.", "", "| fact | value |", "|---|---|"]
    for part in ("metadata", "states", "reasons"):
        lines += [f"| {k} | {v} |" for k, v in sorted(facts[part].items())]
    return "\n".join([*lines, f"| scored | {facts['scored']} |", f"| flagged | {facts['flagged']} |", "", "Rows of the review queue are candidates for review and establish nothing.", ""])


def page(facts: dict) -> str:
    """A static page with a filter box over the summary's rows."""
    rows = "".join(f"<tr><td>{html.escape(str(k))}</td><td>{html.escape(str(v))}</td></tr>" for part in ("metadata", "states", "reasons") for k, v in sorted(facts[part].items()))
    script = "document.getElementById('q').oninput=e=>document.querySelectorAll('tr').forEach(r=>r.hidden=!r.textContent.includes(e.target.value))"
    return f"<!doctype html><meta charset='utf-8'><title>Replay</title><h1>Replay: {html.escape(facts['status'])}</h1><input id='q'><table>{rows}</table><script>{script}</script>\n"


def run(spark: SparkSession, output: str, policy: Policy | None = None, catalog: DataFrame | None = None, log: DataFrame | None = None) -> dict:
    """Validate, replay, judge, gate and publish; string inputs, or the synthetic ones."""
    utc(spark)
    policy = policy or Policy()
    if catalog is None or log is None:
        catalog, log = scenarios.synthetic_tables(spark, policy)

    facts: dict = {}

    def build(folder: Path) -> None:
        folder.mkdir()
        catalog.write.parquet(str(folder / "input_cases"))
        log.write.parquet(str(folder / "input_events"))
        raw = spark.read.parquet(str(folder / "input_cases")), spark.read.parquet(str(folder / "input_events"))
        typed = contracts.validate(*raw, policy.service_groups)
        results = evaluate(*typed, policy)
        for name, table in artifacts(results).items():
            table.orderBy(*ARTIFACTS[name]).write.parquet(str(folder / name))
        results.members.orderBy("case_id").write.parquet(str(folder / "baseline_members"))
        T.write_json(folder / "frozen_baseline.json", results.document)
        T.write_json(folder / "source_manifest.json", manifest(typed[1], policy, results))
        gate_rows = [r.asDict() for r in G.gates(*typed, results, policy).orderBy("check_name").collect()]
        facts.update(summary(results, typed[1], gate_rows))
        if facts["status"] != "PASS":
            raise ReplayError(f"gates failed: {[g for g in gate_rows if g['failures']]}")
        (folder / "policy.json").write_text(policy.to_json())
        T.write_json(folder / "gates.json", gate_rows)
        T.write_json(folder / "summary.json", facts)
        (folder / "summary.md").write_text(markdown(facts))
        (folder / "index.html").write_text(page(facts))
        T.seal(folder, INVENTORY, {"status": facts["status"]})

    T.publish(output, build)
    verify(spark, output)
    return facts


def verify(spark: SparkSession, output: str) -> dict:
    """Check the seal of the current version, then derive everything anew from the saved inputs and compare, rows both ways."""
    utc(spark)
    folder = T.current(output)
    receipt = T.check_receipt(folder, INVENTORY)
    saved = {name: json.loads((folder / name).read_text()) for name in ("policy.json", "frozen_baseline.json", "source_manifest.json", "gates.json")}
    policy = parse_policy(saved["policy.json"])
    typed = contracts.validate(spark.read.parquet(str(folder / "input_cases")), spark.read.parquet(str(folder / "input_events")), policy.service_groups)
    results = evaluate(*typed, policy)
    for name, table in {**artifacts(results), "baseline_members": results.members}.items():
        if not T.same_rows(table, spark.read.parquet(str(folder / name)).select(*table.columns)):
            raise ReplayError(f"{name} is not what its inputs give")
    for name, made in (("frozen_baseline.json", results.document), ("source_manifest.json", manifest(typed[1], policy, results))):
        if saved[name] != json.loads(T.canonical(made)):
            raise ReplayError(f"{name} is not what its inputs give")
    if len(saved["gates.json"]) != 26 or any(g["failures"] for g in saved["gates.json"]):
        raise ReplayError("gates.json does not tell of 26 passed gates")
    return receipt


def checkpoint_audit(spark: SparkSession, cases_csv: str, stages_csv: str, output: str | None = None) -> dict:
    """Validate, reconcile, check and summarise two CSV snapshots; aborts unless all passes."""
    raw_cases, raw_stages = T.read_csv(spark, cases_csv, K.CASES), T.read_csv(spark, stages_csv, K.STAGES)
    K.enforce(K.check_cases(raw_cases))
    K.enforce(K.check_stages(raw_stages))
    cases, stages = K.typed_cases(raw_cases).cache(), K.typed_stages(raw_stages).cache()
    found = K.reconcile(cases, stages).first().asDict()
    if any(v for k, v in found.items() if k != "matched"):
        raise ReplayError(f"snapshots do not reconcile: {found}")
    quality = K.quality_summary(K.quality_results(cases, stages))
    if quality["status"] != "PASS":
        raise ReplayError(f"checks failed: {quality}")
    payload = {
        "quality": quality,
        "summary": K.checkpoint_summary(cases).first().asDict(),
        "clocks": [r.asDict() for r in K.process_clock_summary(cases, stages).orderBy("decision_period").collect()],
        "audit": K.clock_audit(stages).first().asDict(),
    }
    if output:
        folder = Path(output)
        folder.mkdir(parents=True, exist_ok=True)
        T.write_json(folder / "checkpoint_audit.json", payload)
        rows = [f"| {k} | {v} |" for k, v in payload["summary"].items()]
        rows += ["", "| period | rows | flagged | restricted | mean days |", "|---|---|---|---|---|", *("| " + " | ".join(map(str, r.values())) + " |" for r in payload["clocks"])]
        (folder / "checkpoint_audit.md").write_text("\n".join(["# Checkpoint audit", "", "| fact | value |", "|---|---|", *rows, ""]))
        body = "".join(f"<li>{html.escape(k)}: {html.escape(str(v))}</li>" for k, v in payload["summary"].items())
        (folder / "index.html").write_text(f"<!doctype html><meta charset='utf-8'><title>Checkpoint audit</title><ul>{body}</ul>\n")
    return payload


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Replay a delivery log and publish what follows from it.")
    parser.add_argument("--output", required=True)
    parser.add_argument("--policy")
    only = parser.add_mutually_exclusive_group()
    only.add_argument("--as-of", help="an instant that replaces the policy's")
    only.add_argument("--verify-only", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    if given.verify_only:
        print(json.dumps(verify(spark, given.output)["status"]))
        return 0
    policy = load_policy(given.policy)
    print(json.dumps(run(spark, given.output, policy.with_(observed_at=given.as_of) if given.as_of else policy), sort_keys=True, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
