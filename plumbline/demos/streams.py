"""Streams over the events table, run to the end of the data and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.demos import derived
from plumbline.demos.registry import demo
from plumbline.operators import assertions as A
from plumbline.operators import probes as P
from plumbline.operators.suites import Suite
from plumbline.session import scratch_path
from plumbline.sources.tables import read_table as t
from plumbline.streaming import jobs

PROBES = [
    P.PopulationProbe("events", "event_type", "error", 0.2, 0.02),
    P.ImplicationProbe("events", "event_type", "purchase", "value", ">", 10, 0.9, 0.05),
]
#: Bytes of files that a micro-batch takes together.
BATCH = 256 << 20
SHOWN = ("signal_type", "current", "alert", "matches", "total")


def _windows_sql(starts: str, days: int) -> str:
    """Windows that a watermark one hour behind the last event has closed."""
    return f"""
    WITH starts AS ({starts}),
    w AS (SELECT s, s + INTERVAL {days} DAY AS e, event_type, value FROM events JOIN starts ON ts >= s AND ts < s + INTERVAL {days} DAY),
    c AS (SELECT s, e, count(*) FILTER (WHERE event_type = 'error') AS m1, count(*) AS n1,
                 count(*) FILTER (WHERE event_type = 'purchase' AND value > 10) AS m2, count(*) FILTER (WHERE event_type = 'purchase') AS n2
          FROM w GROUP BY ALL HAVING e <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)),
    r AS (SELECT s, 'event_type_population_rate_shift' AS signal_type, m1 AS matches, n1 AS total, coalesce(m1::DOUBLE / nullif(n1, 0), 0) AS cur FROM c
          UNION ALL SELECT s, 'event_type_implies_value_decay', m2, n2, coalesce(m2::DOUBLE / nullif(n2, 0), 0) FROM c)
    SELECT strftime(s, '%Y-%m-%d') AS day, signal_type, round(cur, 4) AS current,
           CASE WHEN signal_type LIKE '%shift' THEN abs(cur - 0.2) > 0.02 ELSE 0.9 - cur > 0.05 END AS alert, matches, total
    FROM r
    """


DAYS = "SELECT DISTINCT date_trunc('day', ts) AS s FROM events"
SLIDES = "SELECT DISTINCT date_trunc('day', ts) - to_days(i::INT) AS s FROM events, generate_series(0, 6) g(i)"


def _windows(spark, d, label, duration, slide=None):
    stream = jobs.probe_windows(jobs.file_stream(spark, d, "events"), PROBES, duration, slide)
    path = jobs.run_to_table(stream, label)
    closed = spark.read.parquet(path)
    return closed.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), *SHOWN)


@demo("st_probe_window", _windows_sql(DAYS, 1))
def st_probe_window(spark, d):
    return _windows(spark, d, "probe-window", "1 day")


def _sliding_sql() -> str:
    # seven-day windows start on days counted from the epoch, one each day
    return _windows_sql(SLIDES, 7)


@demo("st_probe_sliding", _sliding_sql())
def st_probe_sliding(spark, d):
    return _windows(spark, d, "probe-sliding", "7 days", "1 day")


def _request_stream(spark, d):
    """The query log, derived from the event stream instead of the table."""
    return derived.log_from(jobs.file_stream(spark, d, "events"))


@demo(
    "st_decisions",
    f"""
    WITH {derived.VIOLATIONS}, per AS (SELECT request_id, count(*) AS n FROM violations GROUP BY 1)
    SELECT q.request_id, CASE WHEN metric_id = 'error' OR n > 0 THEN 'DENY' ELSE 'ALLOW' END AS decision, metric_id <> 'error' AND n IS NULL AS execution_allowed
    FROM query_log q LEFT JOIN per USING (request_id)
    """,
)
def st_decisions(spark, d):
    decided = jobs.decision_stream(_request_stream(spark, d), derived.rules(spark, d))
    path = jobs.run_to_table(decided.select("request_id", "decision", "execution_allowed"), "decisions")
    return spark.read.parquet(path)


@demo(
    "st_trace_select",
    f"""
    WITH {derived.QUERY_LOG} SELECT 'trace-' || request_id AS trace_id, metric_id FROM query_log WHERE k % 4 <> 3 AND k % 29 <> 0
    """,
)
def st_trace_select(spark, d):
    folder = scratch_path(spark, "trace-stream")
    k = F.col("k")
    log = derived.query_log(spark, d).select(
        F.concat(F.lit("trace-"), "request_id").alias("trace_id"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("timestamp"),
        "metric_id",
        F.when(k % 29 != 0, F.col("sql")).alias("sql"),
        F.when(k % 4 == 3, "DENY").when(k % 4 == 2, "AUDIT").otherwise("ALLOW").alias("decision"),
    )
    # every trace is delivered twice
    log.unionByName(log).write.json(folder)
    path = jobs.run_to_table(jobs.trace_stream(spark, folder), "trace-select")
    return spark.read.parquet(path).select("trace_id", "metric_id")


@demo("st_trace_rejects", "SELECT '{\"trace_id\": ' || event_id AS line FROM events WHERE event_id % 13 = 0")
def st_trace_rejects(spark, d):
    folder = scratch_path(spark, "trace-stream")
    event = F.col("event_id")
    good = F.to_json(F.struct(event.cast("string").alias("trace_id")))
    line = F.when(event % 13 == 0, F.concat(F.lit('{"trace_id": '), event)).otherwise(good)
    t(spark, d, "events").select(line.alias("value")).write.text(folder)
    return spark.read.parquet(jobs.run_to_table(jobs.trace_rejects(spark, folder), "trace-rejects"))


@demo(
    "st_suite_batch",
    """
    SELECT 'accepted_range_value' AS name, count(*) FILTER (WHERE value < 0 OR value > 300) = 0 AS passed, count(*) FILTER (WHERE value < 0 OR value > 300) AS violations FROM events
    UNION ALL SELECT 'unique_event_id', TRUE, count(event_id) - count(DISTINCT event_id) FROM events
    """,
)
def st_suite_batch(spark, d):
    suite = Suite(
        "stream", [A.AcceptedRange(column="value", min_value=0, max_value=300), A.Unique(columns=("event_id",))]
    )
    target = scratch_path(spark, "suite-batch")
    jobs.suite_per_batch(jobs.file_stream(spark, d, "events"), suite, target).awaitTermination()
    return spark.read.parquet(f"{target}/data").select("name", "passed", "violations")


@demo(
    "st_suite_across",
    """
    WITH fed AS (SELECT event_id, user_id, value, ts FROM events UNION ALL SELECT event_id, user_id, value, ts FROM events WHERE event_id % 50 = 0
                 UNION ALL SELECT event_id, user_id, value, ts FROM events WHERE event_id % 350 = 0),
    ids AS (SELECT date_trunc('day', ts) AS day, event_id, count(*) AS n FROM fed GROUP BY ALL HAVING count(*) > 1),
    grains AS (SELECT date_trunc('day', ts) AS day, user_id, value, count(*) AS n FROM fed GROUP BY ALL HAVING count(*) > 1)
    SELECT 'accepted_range_value' AS name, count(*) FILTER (WHERE value < 0 OR value > 300) = 0 AS passed, count(*) FILTER (WHERE value < 0 OR value > 300) AS violations, count(value)::DOUBLE AS observed FROM fed
    UNION ALL SELECT 'unique_event_id', count(*) = 0, count(*), coalesce(sum(n - 1), 0)::DOUBLE FROM ids
    UNION ALL SELECT 'grain_user_id_value', count(*) = 0, count(*), coalesce(sum(n - 1), 0)::DOUBLE FROM grains
    """,
)
def st_suite_across(spark, d):
    """Events in three deliveries, each judged by a run of its own; some events come again in a later delivery."""
    suite = Suite(
        "stream", [A.AcceptedRange(column="value", min_value=0, max_value=300), A.Unique(columns=("event_id",)), A.Grain(columns=("user_id", "value"))]
    )
    folder, target = scratch_path(spark, "deliveries"), scratch_path(spark, "suite-across")
    events = t(spark, d, "events")
    for part, delivery in enumerate([events, events.where("event_id % 50 = 0"), events.where("event_id % 350 = 0")]):
        delivery.write.parquet(f"{folder}/events.parquet/part={part}")
        # a delay of forty days: every event may come that late
        stream = jobs.file_stream(spark, folder, "events", bytes_per_trigger=BATCH)
        jobs.suite_across_batches(stream, suite, target, time="ts", within="1 day", delay="40 days")
    return jobs.suite_so_far(spark, suite, target).select("name", "passed", "violations", "observed")
