"""The fourteen business metrics, re-declared on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.demos.registry import demo
from plumbline.plans.spec import Measure, MetricSpec, Predicate, Ratio, Term
from plumbline.sources.tables import read_table as t


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    names = columns or [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})


def share(alias: str, flag: str) -> Ratio:
    return Ratio(alias, Term("1.0D", agg="sum", when=flag), Term("1", agg="count"))


def order_lines(spark, d) -> DataFrame:
    """Lines with their order's customer, status and date."""
    orders = t(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    return t(spark, d, "lineitem").join(orders, "l_orderkey")


NET_REVENUE = MetricSpec(
    "net_revenue",
    dims=(("customer_id", "o_custkey"), ("reporting_month", "date_format(l_shipdate, 'yyyy-MM')")),
    measures=(
        Measure(
            "net_revenue",
            (
                Term("l_extendedprice", when="l_returnflag <> 'R'"),
                Term("l_extendedprice", when="l_returnflag = 'R'", sign=-1),
            ),
        ),
    ),
    filters=(Predicate("l_linestatus", "=", "'O'"), Predicate("o_orderstatus", "=", "'F'")),
)

NET_REVENUE_SQL = """
    SELECT o_custkey AS customer_id, strftime(l_shipdate, '%Y-%m') AS reporting_month,
           sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END)
         - sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS net_revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE {where} GROUP BY ALL
"""
NET_REVENUE_WHERE = "l_linestatus = 'O' AND o_orderstatus = 'F'"


@demo(
    "m_net_revenue",
    f"SELECT customer_id, reporting_month, round(net_revenue, 2) AS net_revenue "
    f"FROM ({NET_REVENUE_SQL.format(where=NET_REVENUE_WHERE)})",
)
def m_net_revenue(spark, d):
    return rounded(NET_REVENUE.run(order_lines(spark, d)), 2)


AOV = MetricSpec(
    "average_order_value",
    dims=(("customer_id", "o_custkey"),),
    measures=(Measure("avg_order_value", (Term("o_totalprice", agg="avg"),)),),
    filters=(Predicate("o_totalprice", ">", "60000"), Predicate("o_orderstatus", "=", "'F'")),
)


@demo(
    "m_aov",
    """
    SELECT o_custkey AS customer_id, round(avg(o_totalprice), 6) AS avg_order_value FROM orders
    WHERE o_totalprice > 60000 AND o_orderstatus = 'F' GROUP BY 1
    """,
)
def m_aov(spark, d):
    return rounded(AOV.run(t(spark, d, "orders")))


MAU = MetricSpec(
    "monthly_active_users",
    dims=(("reporting_month", "date_format(ts, 'yyyy-MM')"), ("event_type", "event_type")),
    measures=(Measure("active_users", (Term("user_id", agg="count", distinct=True),)),),
    filters=(Predicate("value", ">", "10"), Predicate("user_id % 10", "<>", "3")),
)


@demo(
    "m_mau",
    """
    SELECT strftime(ts, '%Y-%m') AS reporting_month, event_type, count(DISTINCT user_id) AS active_users FROM events
    WHERE value > 10 AND user_id % 10 <> 3 GROUP BY ALL
    """,
)
def m_mau(spark, d):
    return MAU.run(t(spark, d, "events"))


@demo(
    "m_churn",
    """
    SELECT c_mktsegment AS plan, round(count(CASE WHEN c_acctbal < 0 THEN 1 END)::DOUBLE / count(*), 8) AS churn_rate
    FROM customer WHERE c_nationkey <> 0 GROUP BY 1
    """,
)
def m_churn(spark, d):
    spec = MetricSpec(
        "customer_churn_rate",
        dims=(("plan", "c_mktsegment"),),
        measures=(Ratio("churn_rate", Term("1", agg="count", when="c_acctbal < 0"), Term("1", agg="count")),),
        filters=(Predicate("c_nationkey", "<>", "0"),),
    )
    return rounded(spec.run(t(spark, d, "customer")), 8)


@demo(
    "m_retention",
    """
    WITH q AS (SELECT DISTINCT o_custkey, year(o_orderdate) * 4 + quarter(o_orderdate) AS quarter_no FROM orders),
         first AS (SELECT o_custkey, min(quarter_no) AS cohort FROM q GROUP BY 1)
    SELECT cohort::BIGINT AS cohort_id,
           round(sum(CASE WHEN n.o_custkey IS NOT NULL THEN 1 ELSE 0 END)::DOUBLE / count(*), 8) AS retention_rate
    FROM first f LEFT JOIN q n ON n.o_custkey = f.o_custkey AND n.quarter_no = f.cohort + 1 GROUP BY 1
    """,
)
def m_retention(spark, d):
    orders = t(spark, d, "orders").select(
        "o_custkey", (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("bigint").alias("q")
    )
    # the smallest quarter decides the cohort; quarters of one customer are few once de-duplicated
    firsts = orders.groupBy("o_custkey").agg(F.min("q").alias("cohort_id"))
    quarters = orders.distinct().withColumn("cohort_id", F.col("q") - 1)
    flagged = firsts.join(
        quarters.select("o_custkey", "cohort_id", F.lit(True).alias("came_back")), ["o_custkey", "cohort_id"], "left"
    ).withColumn("returned_next_period", F.coalesce("came_back", F.lit(False)))
    spec = MetricSpec(
        "customer_retention_rate",
        dims=(("cohort_id", "cohort_id"),),
        measures=(share("retention_rate", "returned_next_period"),),
    )
    return rounded(spec.run(flagged), 8)


@demo(
    "m_inventory",
    """
    SELECT p_brand AS warehouse_id, round(sum(l_extendedprice) / nullif(sum(p_retailprice), 0), 8) AS turnover_ratio
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 5 GROUP BY 1
    """,
)
def m_inventory(spark, d):
    # lines per part first: a part that sells in every order joins once per task
    lines = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum("l_extendedprice").alias("cogs"), F.count(F.lit(1)).alias("n")
    )
    parts = t(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    spec = MetricSpec(
        "inventory_turnover",
        dims=(("warehouse_id", "p_brand"),),
        measures=(Ratio("turnover_ratio", Term("cogs"), Term("p_retailprice * n")),),
        filters=(Predicate("p_size", ">", "5"),),
    )
    return rounded(spec.run(lines.join(parts, "p_partkey")), 8)


@demo(
    "m_sla",
    """
    SELECT o_orderpriority AS priority,
           round(sum(CASE WHEN date_diff('day', o_orderdate, l_shipdate) <= 90 THEN 1 ELSE 0 END)::DOUBLE / count(*), 8) AS sla_rate
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY 1
    """,
)
def m_sla(spark, d):
    spec = MetricSpec(
        "sla_compliance_rate",
        dims=(("priority", "o_orderpriority"),),
        measures=(share("sla_rate", "datediff(l_shipdate, o_orderdate) <= 90"),),
        filters=(Predicate("o_orderpriority", "<>", "'4-NOT SPECIFIED'"),),
    )
    return rounded(spec.run(order_lines(spark, d)), 8)


@demo(
    "m_conversion",
    """
    SELECT round(count(CASE WHEN event_type = 'purchase' THEN 1 END)::DOUBLE / count(*), 8) AS conversion_rate
    FROM events WHERE event_type <> 'error'
    """,
)
def m_conversion(spark, d):
    spec = MetricSpec(
        "checkout_conversion_rate",
        dims=(),
        measures=(
            Ratio("conversion_rate", Term("1", agg="count", when="event_type = 'purchase'"), Term("1", agg="count")),
        ),
        filters=(Predicate("event_type", "<>", "'error'"),),
    )
    return rounded(spec.run(t(spark, d, "events")), 8)


@demo(
    "m_roas",
    """
    SELECT user_id % 4 AS channel,
           round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END)
               / nullif(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END), 0), 8) AS roas
    FROM events WHERE event_type <> 'error' GROUP BY 1
    """,
)
def m_roas(spark, d):
    spec = MetricSpec(
        "ad_campaign_roas",
        dims=(("channel", "user_id % 4"),),
        measures=(
            Ratio("roas", Term("value", when="event_type = 'purchase'"), Term("value", when="event_type = 'click'")),
        ),
        filters=(Predicate("event_type", "<>", "'error'"),),
    )
    return rounded(spec.run(t(spark, d, "events")), 8)


ARR = MetricSpec(
    "b2b_saas_arr",
    dims=(("customer_id", "o_custkey"),),
    measures=(Measure("annual_recurring_revenue", (Term("l_extendedprice * 12.0D"),)),),
    filters=(Predicate("o_orderstatus", "=", "'O'"), Predicate("l_returnflag", "<>", "'R'")),
)


@demo(
    "m_arr",
    """
    SELECT o_custkey AS customer_id, round(sum(l_extendedprice * 12.0::DOUBLE), 2) AS annual_recurring_revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderstatus = 'O' AND l_returnflag <> 'R' GROUP BY 1
    """,
)
def m_arr(spark, d):
    return rounded(ARR.run(order_lines(spark, d)), 2)


@demo(
    "m_burn",
    """
    SELECT l_suppkey AS team, round(sum(l_quantity * p_retailprice) - sum(l_extendedprice * l_discount), 4) AS net_compute_cost
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> 'PROMO' GROUP BY 1
    """,
)
def m_burn(spark, d):
    # per (part, supplier) first, so a hot part does not carry its lines through the join
    lines = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), "l_suppkey").agg(
        F.sum("l_quantity").alias("hours"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("credit")
    )
    parts = t(spark, d, "part").select("p_partkey", "p_type", "p_retailprice")
    spec = MetricSpec(
        "cloud_compute_burn_rate",
        dims=(("team", "l_suppkey"),),
        measures=(Measure("net_compute_cost", (Term("hours * p_retailprice"), Term("credit", sign=-1))),),
        filters=(Predicate("p_type", "<>", "'PROMO'"),),
    )
    return rounded(spec.run(lines.join(parts, "p_partkey")), 4)


@demo(
    "m_chargeback",
    """
    SELECT l_suppkey AS merchant_id, round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE / count(*), 8) AS chargeback_rate
    FROM lineitem WHERE l_tax > 0 AND l_linestatus = 'F' GROUP BY 1
    """,
)
def m_chargeback(spark, d):
    spec = MetricSpec(
        "fintech_chargeback_rate",
        dims=(("merchant_id", "l_suppkey"),),
        measures=(share("chargeback_rate", "l_returnflag = 'R'"),),
        filters=(Predicate("l_tax", ">", "0"), Predicate("l_linestatus", "=", "'F'")),
    )
    return rounded(spec.run(t(spark, d, "lineitem")), 8)


@demo(
    "m_readmission",
    """
    WITH o AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS day FROM orders),
         f AS (SELECT o_custkey, day, lead(day) OVER (PARTITION BY o_custkey ORDER BY day) AS next_day FROM o)
    SELECT c_mktsegment AS department,
           round(sum(CASE WHEN next_day - day <= 30 THEN 1 ELSE 0 END)::DOUBLE / count(*), 8) AS readmission_rate
    FROM f JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND c_nationkey <> 7 GROUP BY 1
    """,
)
def m_readmission(spark, d):
    # Days per customer are bounded by the calendar once repeated days are gone, so the
    # window never holds more rows per customer than there are days.
    days = t(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).distinct()
    following = F.lead("day").over(W.partitionBy("o_custkey").orderBy("day"))
    stays = days.withColumn("readmitted_30d", F.coalesce(F.datediff(following, "day") <= 30, F.lit(False)))
    customers = t(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal", "c_nationkey"
    )
    spec = MetricSpec(
        "hospital_readmission_rate",
        dims=(("department", "c_mktsegment"),),
        measures=(share("readmission_rate", "readmitted_30d"),),
        filters=(Predicate("c_acctbal", ">", "0"), Predicate("c_nationkey", "<>", "7")),
    )
    return rounded(spec.run(stays.join(customers, "o_custkey")), 8)


@demo(
    "m_take_rate",
    """
    SELECT l_suppkey AS seller_id, round(sum(l_extendedprice * l_tax) / nullif(sum(l_extendedprice), 0), 8) AS take_rate
    FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber <> 7 GROUP BY 1
    """,
)
def m_take_rate(spark, d):
    spec = MetricSpec(
        "marketplace_take_rate",
        dims=(("seller_id", "l_suppkey"),),
        measures=(Ratio("take_rate", Term("l_extendedprice * l_tax"), Term("l_extendedprice")),),
        filters=(Predicate("l_returnflag", "<>", "'R'"), Predicate("l_linenumber", "<>", "7")),
    )
    return rounded(spec.run(t(spark, d, "lineitem")), 8)
