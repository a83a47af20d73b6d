import datetime as dt
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from tables import first, rows_by, table

from plumbline.operators import assertions as A
from plumbline.operators import governance as G
from plumbline.operators import probes as P
from plumbline.operators.drift import rule_catalogue
from plumbline.operators.scoring import minimal_structural
from plumbline.operators.suites import Suite
from plumbline.session import scratch_path, shared_dir
from plumbline.sources import documents, sinks, tables
from plumbline.streaming import jobs

# --- sources ----------------------------------------------------------------------------------


def test_csv_keeps_declared_types(spark, tmp_path):
    path = tmp_path / "transactions.csv"
    path.write_text("transaction_id,amount,transaction_date\nT1,10.5,2026-01-05 10:00:00\nT2,,2026-01-06 10:00:00\n")
    df = tables.read_csv(spark, str(path), "transaction_id string, amount double, transaction_date timestamp")
    rows = df.orderBy("transaction_id").collect()
    assert rows[0]["transaction_id"] == "T1" and rows[1]["amount"] is None
    assert rows[0]["transaction_date"] == dt.datetime(2026, 1, 5, 10)
    path.write_text("transaction_id,amount,transaction_date\nT1,ten,2026-01-05 10:00:00\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        tables.read_csv(spark, str(path), "transaction_id string, amount double, transaction_date timestamp").collect()


def test_registered_frames(spark):
    tables.register({"tx_view": table(spark, "net_revenue")})
    assert spark.sql("SELECT count(*) c FROM tx_view").first()["c"] == 6
    default = tables.literal_table(spark, [("T", "C", None, 1.0, "invoice", "active", "NA", None)], tables.TRANSACTIONS_SCHEMA)
    assert len(default.columns) == 8 and default.count() == 1


CONTRACT = """
metric: net_revenue
id: urn:metrics:finance:net_revenue
version: 1.2.0
owner: finance
grain: customer_month
domain: finance
invariants:
  population: {required_filters: ["status = 'active'"]}
  grain: {required_dimensions: [customer_id]}
probes:
  null_drift: [{column: status}]
"""


def test_contract_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "net_revenue.yaml").write_text(CONTRACT)
    (tmp_path / "z_copy.yml").write_text(CONTRACT.replace("1.2.0", "9.9.9"))
    (tmp_path / "broken.yaml").write_text("metric: [unclosed")
    (tmp_path / "other.json").write_text(json.dumps({"owner": "x"}))
    (tmp_path / "readme.txt").write_text("metric: no")
    contracts, rejects = documents.read_contracts(spark, str(tmp_path))
    row = first(contracts)
    assert contracts.count() == 1 and row["version"] == "1.2.0" and row["urn"] == "urn:metrics:finance:net_revenue"
    assert row["invariants"]["population"]["required_filters"] == ["status = 'active'"]
    assert row["metadata"]["domain"] == "finance" and json.loads(row["probes"])["null_drift"] == [{"column": "status"}]
    reasons = {r["path"].rsplit("/", 1)[1]: r["reject"] for r in rejects.collect()}
    assert reasons["other.json"] == "no metric" and reasons["broken.yaml"].startswith("unreadable")
    rules = first(documents.contract_rules(contracts))
    assert rules["metric_id"] == "net_revenue" and rules["timezone"] == "UTC" and rules["required_dimensions"] == ["customer_id"]


def test_json_logs(spark, tmp_path):
    path = tmp_path / "traces.jsonl"
    path.write_text('{"trace_id": "t1", "decision": "ALLOW", "violations": []}\n\n{"trace_id": \n')
    good, bad = documents.read_traces(spark, str(path))
    assert [r["trace_id"] for r in good.collect()] == ["t1"] and bad.count() == 1
    runs = tmp_path / "runs.jsonl"
    runs.write_text('{"scenario_id": "s", "tool_calls": [{"tool": "x", "latency_ms": 1.5}], "abstained": true}\n\n')
    run = first(documents.read_trajectories(spark, str(runs))[0])
    assert run["tool_calls"][0]["tool"] == "x" and run["abstained"] and run["final_sql_hash"] is None


def test_manifest(spark, tmp_path):
    path = tmp_path / "manifest.json"
    path.write_text(
        json.dumps(
            {
                "metadata": {},
                "nodes": {
                    "model.a": {"name": "a", "resource_type": "model", "compiled_code": " SELECT 1 ", "raw_code": "x"},
                    "model.b": {"name": "b", "resource_type": "model", "raw_code": "select 2"},
                    "model.c": {"name": "c", "resource_type": "model"},
                    "seed.d": {"name": "d", "resource_type": "seed"},
                },
            },
            indent=1,
        )
    )
    nodes = documents.read_manifest(spark, str(path))
    strict = {k: r["resolution_status"] for k, r in rows_by(G.manifest_status(nodes), "name").items()}
    assert strict == {
        "a": "COMPILED_SQL_PRESENT", "b": "COMPILED_SQL_ABSENT", "c": "COMPILED_SQL_ABSENT", "d": "UNSUPPORTED_RESOURCE_TYPE",
    }
    lax = rows_by(G.manifest_status(nodes, require_compiled=False), "name")
    assert lax["b"]["sql"] == "select 2" and lax["a"]["sql"] == "SELECT 1" and lax["c"]["resolution_status"] == "COMPILED_SQL_ABSENT"


def test_integrity(spark):
    df = spark.createDataFrame(
        [("abcdefg999", "abcdefg"), ("abcdefg", "abcdefg123"), ("x", "abcdefg"), (None, "a"), ("abcdefg", None)],
        "current_commit string, declared_commit string",
    )
    assert [r["integrity"] for r in G.integrity_status(df).collect()] == [
        "VERIFIED", "VERIFIED", "MODIFIED", "UNVERSIONED", "MODIFIED",
    ]


# --- sinks ------------------------------------------------------------------------------------


def test_sinks(spark, tmp_path):
    runs = spark.createDataFrame([(1, "select 1 "), (2, "select 1"), (3, None)], "id int, final_sql_raw string")
    sinks.write_jsonl(runs, str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).columns == ["id"]
    store = str(tmp_path / "store")
    sinks.write_artifacts(runs, "final_sql_raw", store)
    sinks.write_artifacts(runs.union(spark.createDataFrame([(4, "select 4")], runs.schema)), "final_sql_raw", store)
    assert sorted(r["sql"] for r in spark.read.parquet(store).collect()) == ["select 1", "select 4"]
    findings = spark.createDataFrame([("FILTER_REMOVAL", "FATAL"), ("NULL_HANDLING_DRIFT", "MEDIUM")], "drift_type string, severity string")
    rows, catalogue = sinks.findings_report(findings)
    assert {r["level"] for r in rows.collect()} == {"error", "warning"} and catalogue.count() == 2
    assert rule_catalogue(findings, "X-").where("rule_id = 'X-FILTER_REMOVAL'").count() == 1
    pairs = spark.createDataFrame([("p", "train"), ("q", "holdout")], "prompt string, s string")
    sinks.write_pairs(pairs, F.col("s"), str(tmp_path / "pairs"))
    assert spark.read.json(str(tmp_path / "pairs") + "/split=train").count() == 1


def test_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark)) and scratch_path(spark, "x") != scratch_path(spark, "x")


def test_minimal_structural(spark):
    df = spark.createDataFrame([(1, None)], "a int, b int")
    assert not first(minimal_structural(df))["passed"]
    assert first(minimal_structural(df.select("a")))["passed"]
    assert not first(minimal_structural(df.select("a").limit(0)))["passed"]


# --- streams ----------------------------------------------------------------------------------


def _stream_events(spark, folder, name, rows):
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_late_rows_are_dropped(spark, tmp_path):
    """Three triggers: the second closes day one, the third brings a row of day one too late."""
    day = lambda d, h: dt.datetime(2026, 1, d, h)
    source = str(tmp_path / "src")
    schema = "ts timestamp, event_type string, value double"
    out = str(tmp_path / "out")
    batches = [
        [(day(1, 5), "error", 1.0), (day(1, 6), "click", 1.0)],
        [(day(3, 12), "click", 1.0)],
        [(day(1, 7), "error", 1.0), (day(5, 12), "click", 1.0)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        windows = jobs.probe_windows(stream, [P.PopulationProbe("m", "event_type", "error", 0.5)])
        jobs.run_to_table(windows, "late", out)
    got = {str(r["window_start"])[:10]: (r["matches"], r["total"]) for r in spark.read.parquet(f"{out}/data").collect()}
    assert got == {"2026-01-01": (1, 2), "2026-01-03": (0, 1)}


def test_windows_on_a_static_frame(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1, 5), "error"), (dt.datetime(2026, 1, 2, 5), "x")], "ts timestamp, event_type string")
    rows = rows_by(jobs.probe_windows(df, [P.PopulationProbe("m", "event_type", "error", 0.5)]), "current")
    assert set(rows) == {0.0, 1.0}


def test_trace_stream_drops_repeats(spark, tmp_path):
    folder = tmp_path / "traces"
    folder.mkdir()
    line = '{"trace_id": "%s", "timestamp": %d, "metric_id": "m", "sql": "s", "decision": "%s"}\n'
    (folder / "1.json").write_text(line % ("a", 100, "ALLOW") + line % ("a", 101, "ALLOW") + line % ("b", 102, "DENY"))
    out = str(tmp_path / "out")
    jobs.run_to_table(jobs.trace_stream(spark, str(folder)), "t", out)
    (folder / "2.json").write_text(line % ("a", 103, "ALLOW") + line % ("c", 104, "AUDIT"))
    jobs.run_to_table(jobs.trace_stream(spark, str(folder)), "t", out)
    assert sorted(r["trace_id"] for r in spark.read.parquet(f"{out}/data").collect()) == ["a", "c"]


def test_suite_per_batch(spark, tmp_path):
    source, target = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(1,), (None,)], "a int").coalesce(1).write.parquet(source)
    suite = Suite("s", [A.NotNull(columns=("a",)), A.Unique(columns=("a",))])
    for _ in range(2):
        stream = spark.readStream.schema("a int").parquet(source)
        jobs.suite_per_batch(stream, suite, target).awaitTermination()
        spark.createDataFrame([(7,), (7,)], "a int").coalesce(1).write.mode("append").parquet(source)
    results = spark.read.parquet(f"{target}/data").collect()
    assert {(r["batch_id"], r["name"], r["violations"]) for r in results} == {
        (0, "not_null_a", 1), (0, "unique_a", 0), (1, "not_null_a", 0), (1, "unique_a", 1),
    }


@pytest.mark.parametrize("within", [None, "1 day"])
def test_repeats_are_found_across_batches_and_a_restart(spark, tmp_path, within):
    source, target = str(tmp_path / "src"), str(tmp_path / "out")
    suite = Suite("s", [A.Unique(columns=("a", "b")), A.NotNull(columns=("c",)), A.Grain(columns=("c",))])
    deliveries = [
        [(1, "x", 1, "2024-01-01 01:00"), (2, "x", 2, "2024-01-01 02:00"), (None, "x", 3, "2024-01-01 02:00"), (None, "x", None, "2024-01-01 02:00")],
        [(1, "x", 4, "2024-01-01 23:00"), (1, "y", 5, "2024-01-01 03:00"), (3, "z", 6, "2024-01-01 04:00"), (3, "z", 6, "2024-01-01 05:00")],
        [(1, "x", 7, "2024-01-01 06:00"), (2, "x", 8, "2024-01-02 02:00")],
    ]
    every = []
    for rows in deliveries:
        every += rows
        df = spark.createDataFrame(rows, "a int, b string, c int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)  # a new query on the same target: the driver came back
        jobs.suite_across_batches(stream, suite, target, time="ts", within=within, delay="3 days")
        table = spark.createDataFrame(every, "a int, b string, c int, ts string").withColumn("day", F.substring("ts", 1, 10))
        got = {r["name"]: (r["passed"], r["violations"], r["observed"]) for r in jobs.suite_so_far(spark, suite, target).collect()}
        for name, keys in (("unique_a_b", ["a", "b"]), ("grain_c", ["c"])):
            counts = table.dropna(subset=keys).groupBy(*keys, *(["day"] if within else [])).count().where("count > 1").collect()
            assert got[name] == (not counts, len(counts), sum(r["count"] - 1 for r in counts))
        assert got["not_null_c"][:2] == (False, 1)
    assert got["unique_a_b"] == ((False, 2, 3.0) if within else (False, 3, 4.0))


def test_state_of_passed_windows_is_dropped(spark, tmp_path):
    source, target = str(tmp_path / "src"), str(tmp_path / "out")
    suite = Suite("s", [A.Unique(columns=("a",))])
    for rows in ([(1, "2024-01-01 01:00")], [(9, "2024-01-09 00:00")], [(9, "2024-01-09 01:00"), (1, "2024-01-01 02:00")]):
        df = spark.createDataFrame(rows, "a int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(source)
        jobs.suite_across_batches(spark.readStream.schema(df.schema).parquet(source), suite, target, time="ts", within="1 day", delay="1 hour")
    assert [(r["violations"], r["observed"]) for r in jobs.suite_so_far(spark, suite, target).collect()] == [(1, 1.0)]


def test_micro_batches_are_bounded_by_bytes_whatever_the_number_of_files(spark, tmp_path):
    rows = spark.range(60).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts")
    rows.repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    files = [os.path.getsize(f"{tmp_path}/events.parquet/{name}") for name in os.listdir(f"{tmp_path}/events.parquet") if name.endswith(".parquet")]
    assert len(files) == 6
    for limit, batches in ((sum(files), 1), (1, 6)):
        target = f"{tmp_path}/target-{limit}"
        stream = jobs.file_stream(spark, str(tmp_path), "events", bytes_per_trigger=limit)
        jobs.suite_per_batch(stream, Suite("s", [A.Unique(columns=("event_id",))]), target).awaitTermination()
        assert spark.read.parquet(f"{target}/data").select("batch_id").distinct().count() == batches


def test_streams_read_a_file_and_a_folder_of_parts_alike(spark, sf, tmp_path):
    from plumbline.demos.streams import st_probe_window

    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    one = sorted(tuple(r) for r in st_probe_window(spark, sf).collect())
    assert one and sorted(tuple(r) for r in st_probe_window(spark, str(tmp_path)).collect()) == one


def test_malformed_trace_lines_are_kept(spark, tmp_path):
    good = json.dumps({"trace_id": "t", "timestamp": 1.0, "metric_id": "m", "sql": "s", "decision": "ALLOW"})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(f"{good}\n\n{{broken\n[1]\n")
    rejects = jobs.run_to_table(jobs.trace_rejects(spark, str(tmp_path / "in")), "r", str(tmp_path / "out"))
    assert "{broken" in {r["line"] for r in spark.read.parquet(rejects).collect()}
    traces = jobs.run_to_table(jobs.trace_stream(spark, str(tmp_path / "in")), "t", str(tmp_path / "out2"))
    assert [r["trace_id"] for r in spark.read.parquet(traces).collect()] == ["t"]


@pytest.mark.parametrize("odd", ["metadata: [1]", "metadata: text", "tags: {a: 1}", "invariants: [1]", "dimensions: abc", "provenance: x"])
def test_documents_of_odd_shape_are_refused(spark, odd):
    df = spark.createDataFrame([("a", f"metric: m\n{odd}\n"), ("b", "metric: n\n")], "path string, content string")
    rows = rows_by(documents.parse_contracts(df), "path")
    assert rows["a"]["reject"].startswith("wrong type") and rows["b"]["reject"] is None


def test_a_cluster_without_shared_folder_is_an_error():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def test_queries_run_from_any_working_directory(sf, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
print("rows", __spark_entry__.queries()["pv_claims"](spark, {sf!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]
