"""Perturbed metrics: base and variant of every fault, and all faults at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.demos.metrics import AOV, ARR, MAU, NET_REVENUE, NET_REVENUE_SQL, NET_REVENUE_WHERE, order_lines, rounded
from plumbline.demos.registry import demo
from plumbline.plans.factorised import with_lost_join
from plumbline.plans.spec import Measure, MetricSpec, Predicate, Ratio, Term
from plumbline.plans.variants import run_one, run_variants
from plumbline.sources.tables import read_table as t


def _net(variant: str, where: str, month: str = "reporting_month", sign: str = "-") -> str:
    inner = NET_REVENUE_SQL.format(where=where).replace("- sum", f"{sign} sum")
    return f"SELECT '{variant}' AS variant, customer_id, {month} AS reporting_month, round(net_revenue, 6) AS net_revenue FROM ({inner})"


NET_BASE = _net("BASE", NET_REVENUE_WHERE)
NET_FILTER_DROP = _net("FILTER_DROP", "l_linestatus = 'O'")
NET_BOUNDARY = _net("BOUNDARY_SHIFT", "l_linestatus != 'O' AND o_orderstatus = 'F'")
NET_INVERT = _net("MATH_OPERATOR_INVERT", NET_REVENUE_WHERE, sign="+")
NET_SWAP = _net("AGGREGATION_SWAP", NET_REVENUE_WHERE).replace(
    "sum(CASE WHEN l_returnflag <> 'R'", "avg(CASE WHEN l_returnflag <> 'R'"
)
NET_GRAIN = f"""
    SELECT 'GRAIN_DROP' AS variant, customer_id, NULL AS reporting_month, round(sum(net_revenue), 6) AS net_revenue
    FROM ({NET_REVENUE_SQL.format(where=NET_REVENUE_WHERE)}) GROUP BY customer_id
"""


@demo("var_filter_drop", f"{NET_BASE} UNION ALL {NET_FILTER_DROP}")
def var_filter_drop(spark, d):
    return rounded(run_one(NET_REVENUE, order_lines(spark, d), "FILTER_DROP"))


@demo(
    "var_boundary",
    """
    SELECT 'BASE' AS variant, o_custkey AS customer_id, round(avg(o_totalprice), 6) AS avg_order_value FROM orders
    WHERE o_totalprice > 60000 AND o_orderstatus = 'F' GROUP BY ALL
    UNION ALL
    SELECT 'BOUNDARY_SHIFT', o_custkey, round(avg(o_totalprice), 6) FROM orders
    WHERE o_totalprice >= 60000 AND o_orderstatus = 'F' GROUP BY ALL
    """,
)
def var_boundary(spark, d):
    return rounded(run_one(AOV, t(spark, d, "orders"), "BOUNDARY_SHIFT"))


@demo(
    "var_agg_swap",
    """
    SELECT 'BASE' AS variant, o_custkey AS customer_id, round(sum(l_extendedprice * 12.0::DOUBLE), 6) AS annual_recurring_revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND l_returnflag <> 'R' GROUP BY ALL
    UNION ALL
    SELECT 'AGGREGATION_SWAP', o_custkey, round(avg(l_extendedprice * 12.0::DOUBLE), 6)
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND l_returnflag <> 'R' GROUP BY ALL
    """,
)
def var_agg_swap(spark, d):
    return rounded(run_one(ARR, order_lines(spark, d), "AGGREGATION_SWAP"))


@demo(
    "var_distinct_drop",
    """
    WITH kept AS (SELECT *, strftime(ts, '%Y-%m') AS reporting_month FROM events WHERE value > 10 AND user_id % 10 <> 3)
    SELECT 'BASE' AS variant, reporting_month, event_type, count(DISTINCT user_id)::DOUBLE AS active_users FROM kept GROUP BY ALL
    UNION ALL
    SELECT 'DISTINCT_DROP', reporting_month, event_type, count(user_id)::DOUBLE FROM kept GROUP BY ALL
    """,
)
def var_distinct_drop(spark, d):
    return run_one(MAU, t(spark, d, "events"), "DISTINCT_DROP")


SPEND = MetricSpec(
    "customer_spend",
    dims=(("customer_id", "o_custkey"),),
    measures=(
        Measure("spend", (Term("o_totalprice"),)),
        Measure("orders", (Term("o_orderkey", agg="count"),)),
        Measure("mean_spend", (Term("o_totalprice", agg="avg"),)),
    ),
    filters=(Predicate("o_orderstatus", "=", "'F'"),),
)


@demo(
    "var_join_fanout",
    """
    SELECT 'BASE' AS variant, o_custkey AS customer_id, round(sum(o_totalprice), 6) AS spend,
           count(o_orderkey)::DOUBLE AS orders, round(avg(o_totalprice), 6) AS mean_spend
    FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL
    UNION ALL
    SELECT 'JOIN_PREDICATE_DROP', o_custkey, round(sum(o_totalprice), 6), count(o_orderkey)::DOUBLE, round(avg(o_totalprice), 6)
    FROM orders CROSS JOIN nation WHERE o_orderstatus = 'F' GROUP BY ALL
    """,
)
def var_join_fanout(spark, d):
    long = run_variants(SPEND, t(spark, d, "orders"), other_side=t(spark, d, "nation"))
    return rounded(long.where(F.col("variant").isin("BASE", "JOIN_PREDICATE_DROP")))


EXPOSURE = MetricSpec(
    "exposure",
    dims=(("priority", "o_orderpriority"), ("segment", "c_mktsegment")),
    measures=(
        Measure("exposure", (Term("price * balance"), Term("price * balance", when="balance < 0", sign=-1))),
        Measure("pairs", (Term("o_orderkey", agg="count"),)),
        Measure("nations", (Term("c_nationkey", agg="count", distinct=True),)),
        Measure("mean_price", (Term("price", agg="avg"),)),
        Measure("mean_exposure", (Term("price * balance", agg="avg"),)),
        Ratio("price_share", Term("price"), Term("price * balance")),
    ),
    filters=(Predicate("o_orderstatus", "=", "'F'"), Predicate("c_nationkey", "<>", "3")),
)
_EXPOSURE_SQL = """
    SELECT '{variant}' AS variant, o_orderpriority AS priority, c_mktsegment AS segment,
           (sum(price * balance) - sum(CASE WHEN balance < 0 THEN price * balance ELSE 0 END))::DOUBLE AS exposure, count(o_orderkey)::DOUBLE AS pairs,
           count(DISTINCT c_nationkey)::DOUBLE AS nations, round(avg(price), 6) AS mean_price, round(sum(price * balance)::DOUBLE / count(price * balance), 2) AS mean_exposure,
           round(sum(price)::DOUBLE / nullif(sum(price * balance)::DOUBLE, 0), 9) AS price_share
    FROM o {join} WHERE o_orderstatus = 'F' AND c_nationkey <> 3 GROUP BY ALL
"""


@demo(
    "var_join_fanout_both",
    f"""
    WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(round(o_totalprice) AS BIGINT) AS price FROM orders),
         c AS (SELECT c_custkey, c_nationkey, c_mktsegment, CAST(round(c_acctbal) AS BIGINT) AS balance FROM customer)
    {_EXPOSURE_SQL.format(variant="BASE", join="JOIN c ON o_custkey = c_custkey")}
    UNION ALL {_EXPOSURE_SQL.format(variant="JOIN_PREDICATE_DROP", join="CROSS JOIN c")}
    """,
)
def var_join_fanout_both(spark, d):
    """Grain and measures come from both sides; the lost condition is factorised."""
    orders = t(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("custkey"), "o_orderstatus", "o_orderpriority", F.round("o_totalprice").cast("bigint").alias("price")
    )
    customers = t(spark, d, "customer").select(
        F.col("c_custkey").alias("custkey"), "c_nationkey", "c_mktsegment", F.round("c_acctbal").cast("bigint").alias("balance")
    )
    long = with_lost_join(EXPOSURE, orders, customers, ["custkey"], {"price * balance": ("price", "balance")})
    return long.withColumns({"mean_price": F.round("mean_price", 6), "mean_exposure": F.round("mean_exposure", 2), "price_share": F.round("price_share", 9)})


@demo("var_grain_drop", f"{NET_BASE} UNION ALL {NET_GRAIN}")
def var_grain_drop(spark, d):
    return rounded(run_one(NET_REVENUE, order_lines(spark, d), "GRAIN_DROP"))


DISCOUNTED = MetricSpec(
    "discounted_share",
    dims=(("supplier", "l_suppkey"),),
    measures=(Measure("mean_discount", (Term("nullif(l_discount, 0.0D)", agg="avg", default=0.0),)),),
)


@demo(
    "var_coalesce",
    """
    SELECT 'BASE' AS variant, l_suppkey AS supplier, round(avg(coalesce(nullif(l_discount, 0), 0)), 6) AS mean_discount
    FROM lineitem GROUP BY ALL
    UNION ALL
    SELECT 'COALESCE_BYPASS', l_suppkey, round(avg(nullif(l_discount, 0)), 6) FROM lineitem GROUP BY ALL
    """,
)
def var_coalesce(spark, d):
    return rounded(run_one(DISCOUNTED, t(spark, d, "lineitem"), "COALESCE_BYPASS"))


@demo("var_math_invert", f"{NET_BASE} UNION ALL {NET_INVERT}")
def var_math_invert(spark, d):
    return rounded(run_one(NET_REVENUE, order_lines(spark, d), "MATH_OPERATOR_INVERT"))


@demo(
    "var_all",
    " UNION ALL ".join([NET_BASE, NET_FILTER_DROP, NET_BOUNDARY, NET_SWAP, NET_GRAIN, NET_INVERT]),
)
def var_all(spark, d):
    return rounded(run_variants(NET_REVENUE, order_lines(spark, d), store=True))
