"""Audit checks on large logs: what is read once, built once and not moved by tenant."""

import pytest
from pyspark.sql import functions as F

from plumbline.demos import audit as demos
from plumbline.operators import audit as AU


@pytest.fixture
def events(spark, tmp_path):
    rows = spark.range(0, 1200, 1, 2).selectExpr(
        "id AS event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts", "id % 7 AS user_id", "'view' AS event_type", "id / 4.0D AS value", "'{}' AS props"
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_the_end_of_the_log_is_cut_without_moving_it_by_tenant(spark, events, monkeypatch):
    logs = []
    monkeypatch.setattr(AU, "verify_checkpoints", lambda log, *rest: logs.append(log) or log.selectExpr("1 AS checkpoint_id", "1 AS anchored", "1 AS complete", "1 AS root_ok", "1 AS chain_ok", "1 AS valid"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        demos.au_truncated(spark, events)
        plan = logs[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("query", ["au_checkpoint", "au_checkpoint_many"])
def test_the_chain_is_built_once(spark, events, monkeypatch, query):
    built, real = [], AU.build_chain
    monkeypatch.setattr(AU, "build_chain", lambda *given: built.append(1) or real(*given))
    assert getattr(demos, query)(spark, events).count() and len(built) == 1


def test_a_log_is_read_once_and_each_predecessor_has_to_carry_the_hash(spark):
    """Two events of one number, whose hashes have that of the next event's link as their mean, are no predecessor of it."""
    numbers = [(1, "0" * 64), (1, "0" * 64), (2, "00000005" * 8), (3, None)]
    bare = spark.createDataFrame([(n, p, i) for i, (n, p) in enumerate(numbers)], "sequence_num long, previous_event_hash string, k int")
    for name, kind in AU.EVENT_FIELDS.items():
        if name not in bare.columns:
            bare = bare.withColumn(name, F.lit("t" if name == "tenant_id" else None).cast(kind))
    hashed = bare.withColumn("event_hash", AU.event_hash())
    second = hashed.where("sequence_num = 2").first()["event_hash"]
    bare = bare.withColumn("previous_event_hash", F.coalesce("previous_event_hash", F.lit(second)))
    log = bare.withColumn("event_hash", F.when(F.col("k") == 0, "00000004" * 8).when(F.col("k") == 1, "00000006" * 8).otherwise(AU.event_hash()))
    found = AU.check_chain(log)
    assert {r["sequence_num"]: r["problem"] for r in found.collect()} == {1: "duplicate_sequence", 2: "broken_link", 3: None}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
