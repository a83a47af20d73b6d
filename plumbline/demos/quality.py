"""Assertions, suites and probes on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.demos.metrics import NET_REVENUE, NET_REVENUE_SQL, NET_REVENUE_WHERE, order_lines
from plumbline.demos.registry import demo
from plumbline.operators import assertions as A
from plumbline.operators import monitor as MN
from plumbline.operators import probes as P
from plumbline.operators.suites import Suite, classify_schema_tests, run_suite
from plumbline.session import scratch_path
from plumbline.sources.tables import read_table as t
from plumbline.sources.tables import register

SHOWN = ("name", "type", "passed", "skipped", "violations", "observed")


def _run(df, *checks, tables=None):
    return run_suite(df, Suite("demo", list(checks)), tables).select(*SHOWN)


def _result(name, kind, violations, observed, source, passed=None, skipped="FALSE"):
    passed = passed or f"({violations}) = 0"
    return (
        f"SELECT '{name}' AS name, '{kind}' AS type, {passed} AS passed, {skipped} AS skipped, "
        f"({violations})::BIGINT AS violations, ({observed})::DOUBLE AS observed FROM {source}"
    )


def _lines(spark, d):
    return t(spark, d, "lineitem").withColumns(
        {"flag": F.expr("nullif(l_returnflag, 'A')"), "tax": F.expr("nullif(l_tax, 0.0D)")}
    )


NOT_NULL_SQL = _result(
    "not_null_flag_tax", "not_null",
    "count(*) FILTER (WHERE nullif(l_returnflag, 'A') IS NULL OR nullif(l_tax, 0) IS NULL)",
    "count(*) FILTER (WHERE nullif(l_returnflag, 'A') IS NULL) + count(*) FILTER (WHERE nullif(l_tax, 0) IS NULL)",
    "lineitem",
)


@demo("as_not_null", NOT_NULL_SQL)
def as_not_null(spark, d):
    return _run(_lines(spark, d), A.NotNull(columns=("flag", "tax")))


def _duplicates_sql(name, kind, keys):
    return _result(
        name, kind, "count(*) FILTER (WHERE n > 1)", "coalesce(sum(n - 1), 0)",
        f"(SELECT count(*) AS n FROM lineitem GROUP BY {keys})",
    )


@demo("as_unique", _duplicates_sql("unique_l_orderkey_l_linenumber", "unique", "l_orderkey, l_linenumber"))
def as_unique(spark, d):
    return _run(t(spark, d, "lineitem"), A.Unique(columns=("l_orderkey", "l_linenumber")))


@demo("as_grain", _duplicates_sql("grain_l_orderkey_l_partkey_l_suppkey", "grain", "l_orderkey, l_partkey, l_suppkey"))
def as_grain(spark, d):
    return _run(t(spark, d, "lineitem"), A.Grain(columns=("l_orderkey", "l_partkey", "l_suppkey")))


@demo(
    "as_row_count",
    _result("at_least_one", "row_count", "CASE WHEN count(*) >= 1 THEN 0 ELSE 1 END", "count(*)", "orders")
    + " UNION ALL "
    + _result("at_most_ten", "row_count", "CASE WHEN count(*) <= 10 THEN 0 ELSE 1 END", "count(*)", "orders"),
)
def as_row_count(spark, d):
    return _run(t(spark, d, "orders"), A.RowCount("at_least_one", 1), A.RowCount("at_most_ten", 0, 10))


@demo(
    "as_range",
    _result("accepted_range_l_discount", "accepted_range", "count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.08)", "count(l_discount)", "lineitem")
    + " UNION ALL "
    + _result("strict_quantity", "accepted_range", "count(*) FILTER (WHERE l_quantity <= 1 OR l_quantity >= 50)", "count(l_quantity)", "lineitem"),
)
def as_range(spark, d):
    return _run(
        t(spark, d, "lineitem"),
        A.AcceptedRange(column="l_discount", min_value=0.0, max_value=0.08),
        A.AcceptedRange("strict_quantity", "l_quantity", 1, 50, inclusive=False),
    )


@demo(
    "as_values",
    _result("accepted_values_flag", "accepted_values",
            "count(*) FILTER (WHERE nullif(l_returnflag, 'A') IS NOT NULL AND nullif(l_returnflag, 'A') NOT IN ('R', 'X'))",
            "count(nullif(l_returnflag, 'A'))", "lineitem")
    + " UNION ALL "
    + _result("raw_values", "accepted_values", "count(*) FILTER (WHERE l_linenumber NOT IN (1, 2, 3))", "count(l_linenumber)", "lineitem"),
)
def as_values(spark, d):
    return _run(
        _lines(spark, d),
        A.AcceptedValues(column="flag", values=("R", "X")),
        A.AcceptedValues("raw_values", "l_linenumber", ("1", "1 + 1", "3"), quote=False),
    )


@demo(
    "as_relationships",
    """
    WITH c AS (SELECT CASE WHEN l_returnflag = 'R' THEN l_orderkey + 100000000 WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END AS k
               FROM lineitem),
         bad AS (SELECT k FROM c LEFT JOIN orders ON k = o_orderkey WHERE k IS NOT NULL AND o_orderkey IS NULL)
    SELECT 'relationships_order_id_to_orders_o_orderkey' AS name, 'relationships' AS type, count(*) = 0 AS passed, FALSE AS skipped,
           count(*) AS violations, count(DISTINCT k)::DOUBLE AS observed FROM bad
    UNION ALL
    SELECT 'relationships_order_id_to_missing_id', 'relationships', TRUE, TRUE, 0, NULL FROM (SELECT 1 FROM lineitem HAVING count(*) > 0)
    """,
)
def as_relationships(spark, d):
    key = "CASE WHEN l_returnflag = 'R' THEN l_orderkey + 100000000 WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END"
    child = t(spark, d, "lineitem").select(F.expr(key).alias("order_id"))
    return _run(
        child,
        A.Relationships(from_column="order_id", to_table="orders", to_column="o_orderkey"),
        A.Relationships(from_column="order_id", to_table="missing", to_column="id"),
        tables={"orders": t(spark, d, "orders")},
    )


@demo(
    "as_singular",
    """
    WITH bad AS (SELECT o_custkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
                 HAVING sum(o_totalprice) > 100 * max(abs(c_acctbal)) + 2000000)
    SELECT 'spend_within_reach' AS name, 'singular_sql_test' AS type, count(*) = 0 AS passed, FALSE AS skipped,
           count(*) AS violations, count(*)::DOUBLE AS observed FROM bad
    """,
)
def as_singular(spark, d):
    sql = """
        SELECT o_custkey FROM {{ model }} JOIN {{ customer }} ON o_custkey = c_custkey GROUP BY 1
        HAVING sum(o_totalprice) > 100 * max(abs(c_acctbal)) + 2000000
    """
    return _run(t(spark, d, "orders"), A.Singular("spend_within_reach", sql), tables={"customer": t(spark, d, "customer")})


@demo(
    "as_population",
    """
    WITH target AS (SELECT o_custkey AS customer_id FROM orders WHERE o_totalprice > 100000),
         bad AS (SELECT c_custkey AS customer_id FROM customer WHERE NOT (nullif(c_mktsegment, 'BUILDING') = 'MACHINERY')),
         pairs AS (SELECT target.customer_id FROM target JOIN bad ON target.customer_id = bad.customer_id)
    SELECT 'machinery_only' AS name, 'population' AS type, count(*) = 0 AS passed, FALSE AS skipped,
           count(*) AS violations, count(DISTINCT customer_id)::DOUBLE AS observed FROM pairs
    """,
)
def as_population(spark, d):
    target = t(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("customer_id"))
    source = t(spark, d, "customer").withColumnRenamed("c_custkey", "customer_id")
    check = A.Population("machinery_only", "customers", "nullif(c_mktsegment, 'BUILDING') = 'MACHINERY'", "customer_id")
    return _run(target, check, tables={"customers": source})


@demo(
    "as_metric_value",
    """
    WITH s AS (SELECT round(sum(l_quantity), 2) AS q FROM lineitem)
    SELECT 'expected_total' AS name, 'metric_value' AS type, abs(q - 1500000) <= 75000 AS passed, FALSE AS skipped,
           CASE WHEN abs(q - 1500000) <= 75000 THEN 0 ELSE 1 END::BIGINT AS violations, q AS observed FROM s
    UNION ALL
    SELECT 'expected_nothing', 'metric_value', abs(q) <= 0.001, FALSE, CASE WHEN abs(q) <= 0.001 THEN 0 ELSE 1 END, q FROM s
    UNION ALL
    SELECT 'at_least_one', 'metric_value', q >= 1, FALSE, CASE WHEN q >= 1 THEN 0 ELSE 1 END, q FROM s
    """,
)
def as_metric_value(spark, d):
    return _run(
        t(spark, d, "lineitem"),
        A.MetricValue("expected_total", "l_quantity", expected=1_500_000, tolerance_pct=5.0),
        A.MetricValue("expected_nothing", "l_quantity", expected=0),
        A.MetricValue("at_least_one", "l_quantity", min_value=1),
    ).withColumn("observed", F.round("observed", 2))


NEGATIVES = " OR ".join(f"{c} < 0" for c in ("c_custkey", "c_nationkey", "c_acctbal"))


@demo(
    "as_non_negative",
    _result("non_negative", "non_negative", f"count(*) FILTER (WHERE {NEGATIVES})", "count(*) FILTER (WHERE c_acctbal < 0)", "customer"),
)
def as_non_negative(spark, d):
    return _run(t(spark, d, "customer"), A.NonNegative())


# --- one suite over a metric ------------------------------------------------------------------


def _net_revenue_suite():
    return Suite.from_dict(
        {
            "suite_name": "net_revenue",
            "assertions": [
                {"type": "non_null", "name": "keys_present", "columns": ["customer_id", "reporting_month", "net_revenue"]},
                {"type": "expected_grain", "name": "one_row_per_month", "columns": ["customer_id", "reporting_month"]},
                {"type": "row_count", "name": "some_rows", "min_rows": 1},
                {"type": "range", "name": "plausible", "column": "net_revenue", "min_value": -400000.0, "max_value": 400000.0},
                {"type": "foreign_key", "name": "known_customer", "column": "customer_id", "to_table": "customers", "field": "c_custkey"},
                {"type": "required_filter", "name": "positive_balance", "source_table": "customers",
                 "expression": "c_acctbal >= 0", "join_key": "customer_id"},
                {"type": "custom_sql", "name": "no_zero_customer",
                 "sql": "SELECT customer_id FROM {{ model }} GROUP BY 1 HAVING round(sum(net_revenue), 2) = 0"},
                {"type": "metric_value", "name": "not_negative", "column": "net_revenue", "min_value": 0},
                {"type": "accepted_values", "name": "absent_column", "column": "region", "values": ["NA"]},
            ],
        }
    )


def net_revenue_report(spark, d):
    """Net revenue per customer and month, and whether it passes its contract tests."""
    target = NET_REVENUE.run(order_lines(spark, d))
    customers = t(spark, d, "customer").withColumn("customer_id", F.col("c_custkey"))
    results = run_suite(target, _net_revenue_suite(), {"customers": customers}, store=True)
    return results.withColumn("observed", F.round("observed", 2))


@demo(
    "as_suite",
    f"""
    WITH m AS ({NET_REVENUE_SQL.format(where=NET_REVENUE_WHERE)}),
         r AS (
    SELECT 'keys_present' AS name, 'not_null' AS type,
           count(*) FILTER (WHERE customer_id IS NULL OR reporting_month IS NULL OR net_revenue IS NULL) AS v, 0.0::DOUBLE AS o FROM m
    UNION ALL SELECT 'one_row_per_month', 'grain', count(*) FILTER (WHERE n > 1), coalesce(sum(n - 1), 0)
           FROM (SELECT count(*) AS n FROM m GROUP BY customer_id, reporting_month)
    UNION ALL SELECT 'some_rows', 'row_count', CASE WHEN count(*) >= 1 THEN 0 ELSE 1 END, count(*) FROM m
    UNION ALL SELECT 'plausible', 'accepted_range', count(*) FILTER (WHERE net_revenue < -400000 OR net_revenue > 400000), count(*) FROM m
    UNION ALL SELECT 'known_customer', 'relationships', count(*), count(DISTINCT customer_id)
           FROM m WHERE customer_id NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'positive_balance', 'population', count(*), count(DISTINCT customer_id)
           FROM m JOIN customer ON customer_id = c_custkey WHERE c_acctbal < 0
    UNION ALL SELECT 'no_zero_customer', 'singular_sql_test', count(*), count(*)
           FROM (SELECT 1 FROM m GROUP BY customer_id HAVING round(sum(net_revenue), 2) = 0)
    UNION ALL SELECT 'not_negative', 'metric_value', CASE WHEN sum(net_revenue) >= 0 THEN 0 ELSE 1 END, sum(net_revenue) FROM m
    UNION ALL SELECT 'absent_column', 'accepted_values', 0, NULL FROM (SELECT 1 FROM m HAVING count(*) > 0))
    SELECT 'net_revenue' AS suite, name, type, v = 0 AS passed, name = 'absent_column' AS skipped, v::BIGINT AS violations,
           round(o, 2) AS observed
    FROM r
    """,
)
def as_suite(spark, d):
    return net_revenue_report(spark, d).drop("reason")


@demo(
    "as_schema_tests",
    """
    WITH tests AS (
      SELECT p_brand AS model, CASE WHEN p_size % 7 = 0 THEN NULL ELSE 'col_' || (p_size % 5) END AS column_name,
             CASE p_size % 6 WHEN 0 THEN 'not_null' WHEN 1 THEN 'unique' WHEN 2 THEN 'relationships'
                             WHEN 3 THEN 'expression_is_true' WHEN 4 THEN 'accepted_values' ELSE 'recency' END AS test
      FROM part)
    SELECT model, count(*) AS declared_tests,
           count(*) FILTER (WHERE test NOT IN ('expression_is_true', 'recency')) AS supported_tests,
           count(*) FILTER (WHERE test IN ('expression_is_true', 'recency')) AS skipped_tests,
           coalesce(string_agg(DISTINCT CASE WHEN test IN ('expression_is_true', 'recency')
                      THEN coalesce(column_name, 'model_test') || '.' || test END, ',' ORDER BY
                      CASE WHEN test IN ('expression_is_true', 'recency')
                      THEN coalesce(column_name, 'model_test') || '.' || test END), '') AS skipped_names
    FROM tests GROUP BY 1
    """,
)
def as_schema_tests(spark, d):
    size = F.col("p_size")
    tests = t(spark, d, "part").select(
        F.col("p_brand").alias("model"),
        F.when(size % 7 != 0, F.concat(F.lit("col_"), size % 5)).alias("column_name"),
        F.when(size % 6 == 0, "not_null")
        .when(size % 6 == 1, "unique")
        .when(size % 6 == 2, "relationships")
        .when(size % 6 == 3, "expression_is_true")
        .when(size % 6 == 4, "accepted_values")
        .otherwise("recency")
        .alias("test"),
    )
    return classify_schema_tests(tests).withColumn("skipped_names", F.array_join("skipped_names", ","))


# --- probes -----------------------------------------------------------------------------------

ALERT_SHOWN = ("contract", "signal_type", "baseline", "current", "relative_change", "confidence", "alert", "matches", "total")


def _rate_sql(matches, total="count(*)"):
    return f"coalesce({matches}::DOUBLE / nullif({total}, 0), 0)"


def _probe_sql(contract, signal, baseline, matches, total, tolerance, source, kind, by="", high=None):
    """One probe as SQL; ``kind`` is two (two-sided), drop or bounds."""
    off = {"two": f"abs(cur - {baseline})", "drop": f"{baseline} - cur", "bounds": "0"}[kind]
    change = "0.0" if kind == "bounds" or not baseline else f"(cur - {baseline}) / {baseline} * 100"
    alert = f"cur < {baseline} OR cur > {high}" if kind == "bounds" else f"{off} > {tolerance}"
    conf = (
        "'medium'" if kind == "bounds" or "null" in signal else f"CASE WHEN {off} > {tolerance} * 2 THEN 'high' ELSE 'medium' END"
    )
    base = f"CASE WHEN cur < {baseline} THEN {baseline} ELSE {high} END" if kind == "bounds" else f"{baseline}"
    slice_ = f"{by} AS slice, " if by else ""
    out = "slice, " if by else ""
    group = "GROUP BY 1" if by else ""
    return f"""
    SELECT {out}'{contract}' AS contract, '{signal}' AS signal_type, round(({base})::DOUBLE, 4) AS baseline, round(cur, 4) AS current,
           round(({change})::DOUBLE, 1) AS relative_change, CASE WHEN {alert} THEN {conf} END AS confidence,
           {alert} AS alert, m::BIGINT AS matches, n::BIGINT AS total
    FROM (SELECT {slice_}{matches} AS m, {total} AS n, {_rate_sql(matches, total)} AS cur FROM {source} {group})
    """


POPULATION_SQL = (
    _probe_sql("orders", "o_orderstatus_population_rate_shift", 0.5, "count(*) FILTER (WHERE o_orderstatus = 'F')", "count(*)", 0.05, "orders", "two")
    + " UNION ALL "
    + _probe_sql("orders", "open_population_rate_shift", 0.3, "count(*) FILTER (WHERE nullif(o_orderstatus, 'O') IS NULL)", "count(*)", 0.1, "orders", "two")
)


def _status_orders(spark, d):
    return t(spark, d, "orders").withColumn("open", F.expr("nullif(o_orderstatus, 'O')"))


@demo("pb_population", POPULATION_SQL)
def pb_population(spark, d):
    probes = [P.PopulationProbe("orders", "o_orderstatus", "F", 0.5), P.PopulationProbe("orders", "open", None, 0.3, 0.1)]
    return P.run_probes(_status_orders(spark, d), probes).select(*ALERT_SHOWN)


IMPLICATIONS = (
    ("l_quantity", ">", 25, "l_quantity > 25", 0.9),
    ("l_discount", "<", 0.05, "l_discount < 0.05", 0.5),
    ("l_linestatus", "=", "O", "l_linestatus = 'O'", 0.9),
    ("l_tax", "!=", 0.0, "l_tax != 0", 0.7),
    ("l_shipdate", "IS NOT NULL", None, "l_shipdate IS NOT NULL", 1.0),
)


@demo(
    "pb_implication",
    " UNION ALL ".join(
        _probe_sql("lineitem", f"l_returnflag_implies_{column}_decay", base,
                   f"count(*) FILTER (WHERE l_returnflag = 'R' AND {sql})", "count(*) FILTER (WHERE l_returnflag = 'R')", 0.1, "lineitem", "drop")
        for column, _, _, sql, base in IMPLICATIONS
    ),
)
def pb_implication(spark, d):
    probes = [
        P.ImplicationProbe("lineitem", "l_returnflag", "R", column, op, value, base)
        for column, op, value, _, base in IMPLICATIONS
    ]
    return P.run_probes(t(spark, d, "lineitem"), probes).select(*ALERT_SHOWN)


@demo(
    "pb_null_drift",
    _probe_sql("lineitem", "tax_null_rate_shift", 0.05, "count(*) FILTER (WHERE nullif(l_tax, 0) IS NULL)", "count(*)", 0.02, "lineitem", "two")
    + " UNION ALL "
    + _probe_sql("lineitem", "l_shipdate_null_rate_shift", 0.0, "count(*) FILTER (WHERE l_shipdate IS NULL)", "count(*)", 0.02, "lineitem", "two"),
)
def pb_null_drift(spark, d):
    probes = [P.NullDriftProbe("lineitem", "tax", 0.05), P.NullDriftProbe("lineitem", "l_shipdate")]
    return P.run_probes(_lines(spark, d), probes).select(*ALERT_SHOWN)


BOUNDS_SQL = (
    _probe_sql("lineitem", "returned_share", 0.4, "count(*) FILTER (WHERE l_returnflag = 'R')", "count(*)", 0, "lineitem", "bounds", high=0.6)
    + " UNION ALL "
    + _probe_sql("lineitem", "returned_is_finished", 0.2, "count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F')",
                 "count(*) FILTER (WHERE l_returnflag = 'R')", 0, "lineitem", "bounds", high=1.0)
    + " UNION ALL "
    + _probe_sql("lineitem", "tax_null_bounds", 0.0, "count(*) FILTER (WHERE nullif(l_tax, 0) IS NULL)", "count(*)", 0, "lineitem", "bounds", high=0.05)
)
BOUNDS_CONTRACT = {
    "metric": "lineitem",
    "probes": {
        "population": [{"name": "returned_share", "predicate": "l_returnflag = 'R'", "min_rate": 0.4, "max_rate": 0.6}],
        "implications": [
            {"name": "returned_is_finished", "antecedent": "l_returnflag = 'R'", "consequent": "l_linestatus = 'F'", "min_confidence": 0.2}
        ],
        "null_drift": [{"column": "tax", "max_null_rate": 0.05}],
    },
}


@demo("pb_bounds", BOUNDS_SQL)
def pb_bounds(spark, d):
    return P.run_probes(_lines(spark, d), P.probes_from_contract(BOUNDS_CONTRACT)).select(*ALERT_SHOWN)


@demo(
    "pb_all",
    BOUNDS_SQL
    + " UNION ALL "
    + _probe_sql("returns", "flag_population_rate_shift", 0.33, "count(*) FILTER (WHERE nullif(l_returnflag, 'A') IS NULL)", "count(*)", 0.05, "lineitem", "two")
    + " UNION ALL "
    + _probe_sql("returns", "l_linestatus_implies_l_quantity_decay", 0.95,
                 "count(*) FILTER (WHERE l_linestatus = 'O' AND l_quantity > 10)", "count(*) FILTER (WHERE l_linestatus = 'O')", 0.05, "lineitem", "drop"),
)
def pb_all(spark, d):
    probes = [
        *P.probes_from_contract(BOUNDS_CONTRACT),
        P.PopulationProbe("returns", "flag", None, 0.33),
        P.ImplicationProbe("returns", "l_linestatus", "O", "l_quantity", ">", 10, 0.95, 0.05),
    ]
    return P.run_probes(_lines(spark, d), probes).select(*ALERT_SHOWN)


BY_SLICE_SQL = (
    _probe_sql("events", "event_type_population_rate_shift", 0.2, "count(*) FILTER (WHERE event_type = 'error')", "count(*)", 0.02,
               "events", "two", by="strftime(ts, '%Y-%m-%d')")
    + " UNION ALL "
    + _probe_sql("events", "event_type_implies_value_decay", 0.9, "count(*) FILTER (WHERE event_type = 'purchase' AND value > 10)",
                 "count(*) FILTER (WHERE event_type = 'purchase')", 0.05, "events", "drop", by="strftime(ts, '%Y-%m-%d')")
)
SLICE_PROBES = [
    P.PopulationProbe("events", "event_type", "error", 0.2, 0.02),
    P.ImplicationProbe("events", "event_type", "purchase", "value", ">", 10, 0.9, 0.05),
]


@demo("pb_by_slice", BY_SLICE_SQL)
def pb_by_slice(spark, d):
    events = t(spark, d, "events").withColumn("slice", F.date_format("ts", "yyyy-MM-dd"))
    return P.run_probes(events, SLICE_PROBES, by=["slice"]).select("slice", *ALERT_SHOWN)


@demo("pb_incremental", BY_SLICE_SQL)
def pb_incremental(spark, d):
    """The same from counts kept per day: most days first, then one more day and one that was cut short."""
    path, store = scratch_path(spark, "events"), scratch_path(spark, "monitor")
    events = t(spark, d, "events").withColumn("slice", F.date_format("ts", "yyyy-MM-dd"))
    late, cut = F.dayofmonth("ts") == 3, F.dayofmonth("ts") == 5
    monitor = MN.ProbeMonitor(spark, store, SLICE_PROBES, "slice")
    for rows in (events.where(~late & (~cut | (F.hour("ts") < 6))), events.where(late | cut)):
        rows.write.partitionBy("slice").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
        monitor.refresh(spark.read.schema(events.schema).parquet(path))
    return monitor.results(["slice"]).select("slice", *ALERT_SHOWN)


# --- absent columns and registered frames -----------------------------------------------------------


@demo(
    "prj_present",
    """
    SELECT name, type, TRUE AS passed, skipped, 0::BIGINT AS violations,
           CASE WHEN skipped THEN NULL ELSE (SELECT count(l_tax) FROM lineitem) END::DOUBLE AS observed
    FROM (VALUES ('accepted_range_l_tax', 'accepted_range', FALSE), ('accepted_range_tax_rate', 'accepted_range', TRUE),
                 ('unique_order_id', 'unique', TRUE), ('not_null_order_id', 'not_null', TRUE)) v(name, type, skipped)
    """,
)
def prj_present(spark, d):
    return _run(
        t(spark, d, "lineitem"),
        A.AcceptedRange(column="l_tax", min_value=0),
        A.AcceptedRange(column="tax_rate", min_value=0),
        A.Unique(columns=("order_id",)),
        A.NotNull(columns=("order_id",)),
    )


@demo(
    "src_frame",
    """
    SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS spend
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
    """,
)
def src_frame(spark, d):
    spent = t(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    run = uuid.uuid4().hex
    names = [f"spent_{run}", f"customers_{run}"]
    register(dict(zip(names, [spent, t(spark, d, "customer")], strict=True)))
    try:
        return spark.sql(
            f"""
            SELECT c_mktsegment, sum(n) AS orders, round(sum(total), 2) AS spend
            FROM {names[0]} JOIN {names[1]} ON o_custkey = c_custkey GROUP BY 1
            """
        )
    finally:
        for name in names:
            spark.catalog.dropTempView(name)
