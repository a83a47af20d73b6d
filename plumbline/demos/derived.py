"""Logs, contracts and evaluations that Spark derives from the driver's tables.

Each table comes with the DuckDB common table expressions that give the same
rows.  They grow with their source table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.tables import read_table as t

AGENTS = 4


def _some(*entries: tuple[Column | bool, str]) -> Column:
    """Array of the texts whose condition holds."""
    return F.array_compact(F.array(*[F.when(F.lit(c) if isinstance(c, bool) else c, F.lit(x)) for c, x in entries]))


def _keyed(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint"))


def keyed_events(spark, d) -> DataFrame:
    """Events with the number from their properties."""
    return _keyed(t(spark, d, "events"))


def query_log(spark, d) -> DataFrame:
    return log_from(t(spark, d, "events"))


def log_from(events: DataFrame) -> DataFrame:
    """One logged request per event; the number ``k`` decides which clauses it has."""
    k = F.col("k")
    log = _keyed(events).select(
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("metric_id"),
        F.concat(F.lit("agent_"), F.col("user_id") % AGENTS).alias("agent_id"),
        "k",
        # the same conjunct in other spellings
        _some(
            (k % 3 == 1, "status = 'active'"),
            (k % 3 == 2, "((STATUS  ='active'))"),
            (k % 4 != 0, "region = 'NA'"),
            (k % 11 == 0, "is_test=true"),
        ).alias("where_conjuncts"),
        _some((k % 5 != 0, "t.Customer_Id"), (k % 7 != 0, "date_trunc('month', ts)")).alias("group_by"),
        _some((k % 8 == 0, "AVG(amount)"), (k % 8 != 0, "SUM(amount)"), (k % 9 == 0, "COUNT(id)")).alias("agg_calls"),
        _some((True, "transactions"), (k % 13 == 0, "stg_transactions")).alias("tables"),
        (k % 2).alias("n_joins"),
        F.when(k % 17 == 0, 1).otherwise(0).alias("n_open_joins"),
        F.when(k % 19 == 0, "SUM(amount) > 0").alias("having"),
        (k % 3).alias("n_coalesce"),
        (k % 4).alias("n_cte"),
        (k % 6).alias("n_subquery"),
        F.when(k % 10 == 0, 1).otherwise(0).alias("n_window"),
        (k % 5).alias("n_case"),
        F.floor(F.col("value") * 10_000_000_000).alias("bytes_processed"),
        F.col("value").alias("latency_ms"),
        "ts",
    )
    components = F.concat(F.lit("select 'Invoice'"), F.when(k % 6 != 0, " - 'refund'").otherwise(""))
    zone = F.when(k % 9 == 0, " at TIME ZONE 'EST'").when(k % 9 == 1, " at time zone 'UTC'").otherwise("")
    return log.withColumn("sql", F.concat(components, zone))


QUERY_LOG = """
    keyed AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events),
    query_log AS (
      SELECT event_id AS request_id, event_type AS metric_id, 'agent_' || (user_id % 4) AS agent_id, k,
             list_filter([CASE WHEN k % 3 <> 0 THEN 'status = ''active''' END, CASE WHEN k % 4 <> 0 THEN 'region = ''NA''' END,
                          CASE WHEN k % 11 = 0 THEN 'is_test = true' END], lambda x: x IS NOT NULL) AS where_conjuncts,
             list_filter([CASE WHEN k % 5 <> 0 THEN 't.Customer_Id' END,
                          CASE WHEN k % 7 <> 0 THEN 'date_trunc(''month'', ts)' END], lambda x: x IS NOT NULL) AS group_by,
             list_filter([CASE WHEN k % 8 = 0 THEN 'AVG(amount)' ELSE 'SUM(amount)' END,
                          CASE WHEN k % 9 = 0 THEN 'COUNT(id)' END], lambda x: x IS NOT NULL) AS agg_calls,
             list_filter(['transactions', CASE WHEN k % 13 = 0 THEN 'stg_transactions' END], lambda x: x IS NOT NULL) AS tables,
             k % 2 AS n_joins, CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS n_open_joins,
             k % 3 AS n_coalesce, k % 4 AS n_cte, k % 6 AS n_subquery,
             CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS n_window, k % 5 AS n_case,
             floor(value * 10000000000)::BIGINT AS bytes_processed, value AS latency_ms, ts,
             'select ''Invoice''' || CASE WHEN k % 6 <> 0 THEN ' - ''refund''' ELSE '' END
               || CASE k % 9 WHEN 0 THEN ' at TIME ZONE ''EST''' WHEN 1 THEN ' at time zone ''UTC''' ELSE '' END AS sql
      FROM keyed)"""


def rules(spark, d) -> DataFrame:
    """Contract rules of every event type but ``error``, which stays unknown."""
    kinds = t(spark, d, "events").where("event_type <> 'error'").select(F.col("event_type").alias("metric_id")).distinct()
    strict = F.col("metric_id") == "purchase"

    def texts(*values):
        return F.array(*[F.lit(v) for v in values])

    return kinds.select(
        "metric_id",
        F.when(strict, texts("status = 'active'", "region = 'NA'")).otherwise(texts("status = 'active'")).alias("required_filters"),
        texts("is_test = true").alias("forbidden_filters"),
        F.when(F.col("metric_id") != "view", texts("customer_id", "date_trunc('month', ts)")).alias("required_dimensions"),
        F.when(strict, F.lit("sum")).alias("required_function"),
        texts("invoice").alias("positive_components"),
        texts("refund").alias("negative_components"),
        F.lit("UTC").alias("timezone"),
    )


# the rules spelled out per clause, one row per breach
VIOLATIONS = (
    QUERY_LOG
    + """,
    known AS (SELECT * FROM query_log WHERE metric_id <> 'error'),
    violations AS (
      SELECT request_id, 'required_filters' AS rule, 'population' AS category, 'CRITICAL' AS severity, 'status = ''active''' AS expected
      FROM known WHERE NOT list_contains(where_conjuncts, 'status = ''active''')
      UNION ALL SELECT request_id, 'required_filters', 'population', 'CRITICAL', 'region = ''NA''' FROM known
      WHERE metric_id = 'purchase' AND NOT list_contains(where_conjuncts, 'region = ''NA''')
      UNION ALL SELECT request_id, 'forbidden_filters', 'population', 'CRITICAL', 'is_test = true' FROM known
      WHERE list_contains(where_conjuncts, 'is_test = true')
      UNION ALL SELECT request_id, 'required_dimensions', 'grain', 'CRITICAL', 'customer_id' FROM known
      WHERE metric_id <> 'view' AND k % 5 = 0
      UNION ALL SELECT request_id, 'required_dimensions', 'grain', 'CRITICAL', 'date_trunc(''month'', ts)' FROM known
      WHERE metric_id <> 'view' AND k % 7 = 0
      UNION ALL SELECT request_id, 'required_function', 'aggregation', 'HIGH', 'sum' FROM known
      WHERE metric_id = 'purchase' AND NOT list_contains(agg_calls, 'SUM(amount)')
      UNION ALL SELECT request_id, 'negative_components', 'aggregation', 'HIGH', 'refund' FROM known WHERE NOT contains(sql, 'refund')
      UNION ALL SELECT request_id, 'timezone', 'time', 'HIGH', 'UTC' FROM known
      WHERE contains(lower(sql), 'time zone') AND NOT contains(lower(sql), 'utc'))"""
)


def evaluations(spark, d) -> DataFrame:
    """One evaluated variant per line item and suite.

    The supplier is the model, the part number picks the fault; both suites see
    the same variants and the semantic one fails more of them.
    """
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    faults = F.array(*[F.lit(f) for f in EVALUATED_FAULTS])
    shared = t(spark, d, "lineitem").select(
        F.concat(F.lit("model_"), "l_suppkey").alias("model"),
        F.when(F.col("l_suppkey") % 3 == 0, "holdout").otherwise("dev").alias("track"),
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").cast("bigint")).alias("variant_id"),
        F.get(faults, (part % len(EVALUATED_FAULTS)).cast("int")).alias("operator"),
        (line == 7).alias("runtime_error"),
        (part % 5 == 0).alias("equivalent"),
        F.round(F.col("l_discount") * 100, 2).alias("variance_pct"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_quantity").alias("latency_ms"),
    )
    suites = F.array(
        F.struct(F.lit("standard").alias("suite"), _some((F.col("tax") > 0.06, "unique"), (F.col("tax") == 0.08, "not_null")).alias("failed")),
        F.struct(
            F.lit("semantic").alias("suite"), _some((F.col("tax") > 0.06, "grain"), (F.col("flag") == "R", "population")).alias("failed")
        ),
    )
    return shared.select("*", F.inline(suites)).withColumnRenamed("failed", "assertions_failed")


EVALUATED_FAULTS = (
    "FILTER_DROP",
    "BOUNDARY_SHIFT",
    "AGGREGATION_SWAP",
    "DISTINCT_DROP",
    "JOIN_PREDICATE_DROP",
    "GRAIN_DROP",
    "COALESCE_BYPASS",
    "MATH_OPERATOR_INVERT",
)
FAULT_SQL = "[" + ", ".join(f"'{f}'" for f in EVALUATED_FAULTS) + "]"

EVALUATIONS = f"""
    shared AS (
      SELECT 'model_' || l_suppkey AS model, CASE WHEN l_suppkey % 3 = 0 THEN 'holdout' ELSE 'dev' END AS track,
             l_orderkey || '-' || l_partkey || '-' || l_linenumber || '-' || l_quantity::BIGINT AS variant_id,
             ({FAULT_SQL})[(l_partkey % 8 + 1)::INT] AS operator, l_linenumber = 7 AS runtime_error, l_partkey % 5 = 0 AS equivalent,
             round(l_discount * 100, 2) AS variance_pct, l_tax AS tax, l_returnflag AS flag, l_quantity AS latency_ms
      FROM lineitem),
    evaluations AS (
      SELECT *, CASE WHEN runtime_error THEN 'RUNTIME_ERROR' WHEN equivalent THEN 'EQUIVALENT_ON_FIXTURE'
                     WHEN n_failed > 0 THEN 'VALID_DEFECT_DETECTED' ELSE 'VALID_DEFECT_SURVIVED' END AS classification
      FROM (SELECT *, 'standard' AS suite, (tax > 0.06)::INT + (tax = 0.08)::INT AS n_failed FROM shared
            UNION ALL
            SELECT *, 'semantic' AS suite, (tax > 0.06)::INT + (flag = 'R')::INT AS n_failed FROM shared))"""


def scenarios(spark, d) -> DataFrame:
    """One scenario per user seen in the events."""
    user = F.col("user_id")
    behaviours = F.array(*[F.lit(b) for b in ("PRODUCE_SQL", "PRODUCE_SQL", "ABSTAIN", "ASK_CLARIFICATION", "REQUIRE_REVIEW")])
    classes = F.array(*[F.lit(c) for c in ("clear", "ambiguous", "missing", "conflict")])
    return t(spark, d, "events").select("user_id").distinct().select(
        F.concat(F.lit("scenario_"), user).alias("scenario_id"),
        F.get(classes, (user % 4).cast("int")).alias("scenario_class"),
        F.get(behaviours, (user % 5).cast("int")).alias("expected_behavior"),
        (user % 3 != 0).alias("has_contract"),
        (user % 7 != 0).alias("has_golden"),
    ).where("scenario_id <> 'scenario_1'")


def trajectories(spark, d) -> DataFrame:
    """One agent run per event."""
    k = F.col("k")
    return keyed_events(spark, d).select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("scenario_"), "user_id").alias("scenario_id"),
        F.when(F.col("event_id") % 2 == 0, "blind").otherwise("governed").alias("agent_type"),
        F.when(k % 6 != 0, F.sha2(F.concat(F.lit("sql "), k % 25), 256)).alias("final_sql_hash"),
        (k % 10 != 0).alias("execution_success"),
        (k % 4 != 1).alias("contract_compliant"),
        (k % 3 != 1).alias("result_correct"),
        (k % 6 == 0).alias("abstained"),
        (k % 12 == 0).alias("appropriate_abstention"),
        (k % 33 == 0).alias("ceiling_reached"),
        F.transform(F.sequence(F.lit(1), (k % 4 + 1).cast("int")), lambda i: F.concat(F.lit("call_"), i)).alias("tool_calls"),
        F.col("value").alias("latency_ms"),
        F.when(k % 8 != 0, F.col("value") / 1000.0).alias("estimated_cost_usd"),
    )


TRAJECTORIES = """
    keyed AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events),
    scenarios AS (
      SELECT 'scenario_' || user_id AS scenario_id, (['clear', 'ambiguous', 'missing', 'conflict'])[(user_id % 4 + 1)::INT] AS scenario_class,
             (['PRODUCE_SQL', 'PRODUCE_SQL', 'ABSTAIN', 'ASK_CLARIFICATION', 'REQUIRE_REVIEW'])[(user_id % 5 + 1)::INT] AS expected_behavior,
             user_id % 3 <> 0 AS has_contract, user_id % 7 <> 0 AS has_golden
      FROM (SELECT DISTINCT user_id FROM events) WHERE user_id <> 1),
    trajectories AS (
      SELECT event_id AS run_id, 'scenario_' || user_id AS scenario_id,
             CASE WHEN event_id % 2 = 0 THEN 'blind' ELSE 'governed' END AS agent_type,
             CASE WHEN k % 6 <> 0 THEN sha256('sql ' || (k % 25)) END AS final_sql_hash, k % 25 AS sql_no,
             k % 10 <> 0 AS execution_success, k % 4 <> 1 AS contract_compliant, k % 3 <> 1 AS result_correct,
             k % 6 = 0 AS abstained, k % 12 = 0 AS appropriate_abstention, k % 33 = 0 AS ceiling_reached,
             k % 4 + 1 AS n_calls, value AS latency_ms, CASE WHEN k % 8 <> 0 THEN value / 1000.0 END AS estimated_cost_usd
      FROM keyed)"""


def artifacts(spark, d) -> DataFrame:
    """SQL texts that the store holds: those the runs ended with, but for every fifth."""
    texts = keyed_events(spark, d).select((F.col("k") % 25).alias("sql_no")).distinct().where("sql_no % 5 <> 0")
    return texts.select(F.sha2(F.concat(F.lit("sql "), "sql_no"), 256).alias("sql_hash"), "sql_no")


def verdicts(spark, d) -> DataFrame:
    """Verdict of every (SQL, scenario) pair that occurs in the runs."""
    k, user = F.col("k"), F.col("user_id")
    pairs = keyed_events(spark, d).where("k % 6 <> 0").select((k % 25).alias("sql_no"), "user_id").distinct()
    number = F.col("sql_no")
    return pairs.select(
        F.sha2(F.concat(F.lit("sql "), number), 256).alias("sql_hash"),
        F.concat(F.lit("scenario_"), user).alias("scenario_id"),
        (number % 7 != 0).alias("ran"),
        ((number + user) % 3 != 0).alias("contract_passed"),
        ((number + user) % 4 != 0).alias("matches_golden"),
    )


# grading rules applied to the runs, with the user number of the scenario
GRADED = (
    TRAJECTORIES
    + """,
    judged AS (
      SELECT t.*, s.scenario_class, s.expected_behavior, s.has_contract, s.has_golden, replace(t.scenario_id, 'scenario_', '')::BIGINT AS u
      FROM trajectories t JOIN scenarios s USING (scenario_id)),
    graded AS (
      SELECT * EXCLUDE (execution_success, contract_compliant, result_correct, appropriate_abstention),
             final_sql_hash IS NOT NULL AND sql_no % 7 <> 0 AS execution_success,
             CASE WHEN final_sql_hash IS NULL OR expected_behavior <> 'PRODUCE_SQL' THEN FALSE
                  WHEN NOT has_contract THEN TRUE ELSE (sql_no + u) % 3 <> 0 END AS contract_compliant,
             final_sql_hash IS NOT NULL AND sql_no % 7 <> 0 AND has_golden AND (sql_no + u) % 4 <> 0 AS result_correct,
             abstained AND expected_behavior <> 'PRODUCE_SQL' AS appropriate_abstention
      FROM judged)"""
)


def audit_events(spark, d) -> DataFrame:
    """Audit events of four tenants; sequence numbers run from 1 within each tenant."""
    event = F.col("event_id")
    return t(spark, d, "events").select(
        F.concat(F.lit("ev-"), event).alias("event_id"),
        (F.expr("event_id div 4") + 1).alias("sequence_num"),
        (event + 0.5).cast("double").alias("timestamp_utc"),
        F.lit("tools/call").alias("method"),
        F.col("event_type").alias("tool_name"),
        F.lit(None).cast("string").alias("resource_uri"),
        F.when(event % 3 != 0, F.concat(F.lit('metric "'), F.col("user_id"), F.lit('"'))).alias("metric_id"),
        F.concat(F.lit("tenant_"), event % 4).alias("tenant_id"),
        F.lit("finance").alias("domain"),
        F.sha2(F.col("props"), 256).alias("sql_sha256"),
        F.when(event % 5 == 0, "DENY").otherwise("ALLOW").alias("decision"),
        F.col("value").alias("latency_ms"),
        F.lit("client").alias("client_id"),
        F.lit("key-1").alias("key_id"),
    )


def _audit_sql(segment: int) -> str:
    return f"""
    parts AS (
      SELECT event_id % 4 AS tn, event_id // 4 + 1 AS seq, (event_id // 4) // {segment} AS seg, (event_id // 4) % {segment} AS pos,
             CASE WHEN event_id % 5 = 0 THEN 'DENY' ELSE 'ALLOW' END AS decision,
             '{{"client_id":"client","decision":"' || CASE WHEN event_id % 5 = 0 THEN 'DENY' ELSE 'ALLOW' END
               || '","domain":"finance","event_id":"ev-' || event_id || '","key_id":"key-1","latency_ms":' || value::VARCHAR
               || ',"method":"tools/call","metric_id":' || CASE WHEN event_id % 3 <> 0 THEN '"metric \\"' || user_id || '\\""' ELSE 'null' END
               || ',"previous_event_hash":"' AS head,
             '","resource_uri":null,"sequence_num":' || (event_id // 4 + 1) || ',"sql_sha256":"' || sha256(props)
               || '","tenant_id":"tenant_' || (event_id % 4) || '","timestamp_utc":' || event_id || '.5,"tool_name":"' || event_type || '"}}' AS tail
      FROM events),
    chain AS (
      SELECT tn, seq, seg, pos, CASE WHEN seg = 0 THEN repeat('0', 64) ELSE sha256('segment:tenant_' || tn || ':' || seg) END AS prev,
             sha256(head || CASE WHEN seg = 0 THEN repeat('0', 64) ELSE sha256('segment:tenant_' || tn || ':' || seg) END || tail) AS hash
      FROM parts WHERE pos = 0
      UNION ALL
      SELECT p.tn, p.seq, p.seg, p.pos, c.hash, sha256(p.head || c.hash || p.tail)
      FROM chain c JOIN parts p ON p.tn = c.tn AND p.seg = c.seg AND p.pos = c.pos + 1)"""


AUDIT_SEGMENT = 64
AUDIT_CHAIN = _audit_sql(AUDIT_SEGMENT)
