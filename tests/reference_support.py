"""Small logs for the replay tests."""

from tideclock.operators import contracts
from tideclock.plans.policy import STAGES, instant, instant_text

START = instant("2026-01-01T00:00:00Z")
ARRIVED = instant("2026-01-05T00:00:00Z")
AS_OF = instant("2026-01-06T00:00:00Z")

CATALOG = "case_id string, service_group string, registered_at string, synthetic_record string"
LOG = "delivery_id string, delivery_seq string, event_id string, revision string, case_id string, event_type string, operation string, event_time string, recorded_at string, synthetic_record string"


def event(seq, stage, when, *, recorded=ARRIVED, revision=1, operation="UPSERT", case="C1", event_id=None, delivery=None):
    return {
        "delivery_id": delivery or f"D{seq}", "delivery_seq": str(seq), "event_id": event_id or f"{case}-{stage}", "revision": str(revision), "case_id": case, "event_type": stage,
        "operation": operation, "event_time": instant_text(when) if operation == "UPSERT" else "", "recorded_at": instant_text(recorded), "synthetic_record": "true",
    }


def simple(offsets):
    """One delivery per stage at offsets in hours, all recorded at once."""
    return [event(i + 1, stage, START + round(h * 3600)) for i, (stage, h) in enumerate(zip(STAGES, offsets, strict=False))]


def case(key="C1", group="FLOW_A", at=START):
    return {"case_id": key, "service_group": group, "registered_at": instant_text(at), "synthetic_record": "true"}


def frames(spark, rows, cases=None):
    names = lambda schema: [x.split()[0] for x in schema.split(", ")]
    catalog = spark.createDataFrame([tuple(c[n] for n in names(CATALOG)) for c in cases or [case()]], CATALOG)
    log = spark.createDataFrame([tuple(r[n] for n in names(LOG)) for r in rows], LOG)
    return catalog, log


def typed(spark, rows, cases=None):
    catalog, log = frames(spark, rows, cases)
    return contracts.typed_catalog(catalog), contracts.typed_log(log)
