"""The registered queries of the replay engine against their SQL, and their plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from tideclock.plans import derived
from tideclock.plans.oracle import ORACLE
from tideclock.plans.queries import QUERIES
from tideclock.operators import replay as R

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(rows):
    return sorted((tuple(float(v) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(columns)
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_cutoff_reaches_the_scan_and_a_case_is_shuffled_once(spark, data):
    source = spark.read.parquet(f"{data}/events.parquet").selectExpr("event_id AS delivery_seq", "event_id AS delivery_id", "event_id", "event_id AS revision", "user_id AS case_id", "event_type", "'UPSERT' AS operation", "event_id AS event_epoch", "event_id AS recorded_epoch", "event_id AS input_index")
    plan = R.classify(source, 100)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_id), LessThanOrEqual(event_id,100)]" in plan
    assert plan.count("Exchange ") == 1 and "SinglePartition" not in plan


def test_the_log_is_never_ordered_in_one_task(spark, data):
    actions = R.classify(derived.log(spark, data), derived.OBSERVED)
    plan = R.with_watermark(actions, 86400)._jdf.queryExecution().executedPlan().toString()
    head = plan.split("BroadcastExchange")[0]
    assert "SinglePartition" not in head
