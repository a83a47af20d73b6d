"""Filters, projections, joins, aggregates, comparisons and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.demos.registry import demo
from plumbline.functions.stats import share_of
from plumbline.operators import aggregates, compare, contrast, filters, joins, sketches
from plumbline.operators.percentiles import exact_percentiles
from plumbline.session import scratch_path
from plumbline.sources import sinks
from plumbline.sources.tables import read_table as t

# --- filters and projections -----------------------------------------------------------------


@demo(
    "flt_expr",
    """
    SELECT o_orderpriority AS priority,
           count(*) FILTER (WHERE nullif(o_orderstatus, 'P') = 'F' AND o_totalprice > 100000) AS satisfying,
           count(*) FILTER (WHERE NOT (nullif(o_orderstatus, 'P') = 'F' AND o_totalprice > 100000)) AS breaking
    FROM orders GROUP BY 1
    """,
)
def flt_expr(spark, d):
    predicate = "nullif(o_orderstatus, 'P') = 'F' AND o_totalprice > 100000"
    orders = t(spark, d, "orders")
    kept = filters.satisfying(orders, predicate).select("o_orderpriority", F.lit(1).alias("ok"))
    broken = filters.breaking(orders, predicate).select("o_orderpriority", F.lit(0).alias("ok"))
    return (
        kept.unionByName(broken)
        .groupBy(F.col("o_orderpriority").alias("priority"))
        .agg(F.count_if(F.col("ok") == 1).alias("satisfying"), F.count_if(F.col("ok") == 0).alias("breaking"))
    )


@demo(
    "flt_null",
    """
    SELECT o_orderkey FROM orders
    WHERE nullif(o_orderstatus, 'P') IS NULL OR nullif(o_orderpriority, '5-LOW') IS NULL
    """,
)
def flt_null(spark, d):
    orders = t(spark, d, "orders").select(
        "o_orderkey",
        F.expr("nullif(o_orderstatus, 'P')").alias("status"),
        F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"),
    )
    return orders.where(filters.any_null(["status", "priority"])).select("o_orderkey")


@demo(
    "flt_range",
    """
    SELECT l_returnflag,
           count(*) FILTER (WHERE l_discount < 0.02 OR l_discount > 0.08) AS outside_inclusive,
           count(*) FILTER (WHERE l_discount <= 0.02 OR l_discount >= 0.08) AS outside_strict
    FROM lineitem GROUP BY 1
    """,
)
def flt_range(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(filters.out_of_range("l_discount", 0.02, 0.08)).alias("outside_inclusive"),
        F.count_if(filters.out_of_range("l_discount", 0.02, 0.08, inclusive=False)).alias("outside_strict"),
    )


@demo(
    "flt_in",
    """
    SELECT o_orderkey FROM orders
    WHERE nullif(o_orderstatus, 'P') IS NOT NULL AND nullif(o_orderstatus, 'P') NOT IN ('F', 'X')
    """,
)
def flt_in(spark, d):
    orders = t(spark, d, "orders").withColumn("status", F.expr("nullif(o_orderstatus, 'P')"))
    return orders.where(filters.not_accepted("status", ["F", "X"])).select("o_orderkey")


@demo(
    "prj_case",
    """
    SELECT l_suppkey,
           round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS returned,
           round(sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END), 2) AS accepted
    FROM lineitem GROUP BY 1
    """,
)
def prj_case(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.sum(filters.conditional("l_returnflag = 'R'", "l_extendedprice", 0.0)), 2).alias("returned"),
        F.round(F.sum(filters.conditional("l_returnflag = 'A'", "l_extendedprice")), 2).alias("accepted"),
    )


# --- joins -----------------------------------------------------------------------------------


@demo(
    "jn_inner",
    """
    SELECT o_orderpriority AS priority, count(*) AS lines, round(sum(l_extendedprice), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
    """,
)
def jn_inner(spark, d):
    # lines are summed per order before they meet the orders
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("price")
    )
    return (
        t(spark, d, "orders")
        .join(lines, "o_orderkey")
        .groupBy(F.col("o_orderpriority").alias("priority"))
        .agg(F.sum("n").alias("lines"), F.round(F.sum("price"), 2).alias("revenue"))
    )


BROKEN_KEYS = "CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN l_orderkey + 100000000 WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey END"


@demo(
    "jn_orphan",
    f"""
    SELECT c.key AS key, count(*) AS child_rows
    FROM (SELECT {BROKEN_KEYS} AS key FROM lineitem) c LEFT JOIN orders ON c.key = o_orderkey
    WHERE c.key IS NOT NULL AND o_orderkey IS NULL GROUP BY 1
    """,
)
def jn_orphan(spark, d):
    child = t(spark, d, "lineitem").select(F.expr(BROKEN_KEYS).alias("order_key"))
    return joins.orphan_keys(child, "order_key", t(spark, d, "orders"), "o_orderkey")


@demo(
    "jn_lookup",
    """
    SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
    WHERE n_regionkey IN (0, 2)
    """,
)
def jn_lookup(spark, d):
    nations = t(spark, d, "nation").where("n_regionkey IN (0, 2)").withColumnRenamed("n_nationkey", "s_nationkey")
    return joins.lookup(t(spark, d, "supplier"), nations, "s_nationkey").select("s_suppkey", "n_name")


@demo(
    "jn_artifact",
    """
    SELECT source, count(*) AS runs, count(*) FILTER (WHERE l.doc_id IS NULL) AS unreplayable
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1
    """,
)
def jn_artifact(spark, d):
    stored = t(spark, d, "labels").select("doc_id", F.lit(True).alias("stored"))
    runs = joins.lookup(t(spark, d, "documents").select("doc_id", "source"), stored, "doc_id", required=False)
    return runs.groupBy("source").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("stored").isNull()).alias("unreplayable")
    )


@demo("jn_cross", "SELECT count(*) AS joined_rows FROM orders CROSS JOIN nation")
def jn_cross(spark, d):
    return joins.fanout_counts(t(spark, d, "orders"), t(spark, d, "nation")).select(F.col("joined_rows").cast("bigint").alias("joined_rows"))


# --- aggregates ------------------------------------------------------------------------------


@demo("agg_count", "SELECT count(*) AS n FROM lineitem")
def agg_count(spark, d):
    return t(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@demo(
    "agg_cond_count",
    """
    SELECT count(*) FILTER (WHERE event_type = 'purchase') AS matches, count(*) AS total,
           count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE / count(*) AS rate
    FROM events
    """,
)
def agg_cond_count(spark, d):
    return aggregates.conditional_rate(t(spark, d, "events"), "event_type = 'purchase'")


@demo(
    "agg_dup_groups",
    "SELECT count(*) AS duplicate_groups FROM "
    "(SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
)
def agg_dup_groups(spark, d):
    return aggregates.duplicates(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select("duplicate_groups")


@demo(
    "agg_dup_rows",
    "SELECT sum(n - 1)::BIGINT AS duplicate_rows FROM "
    "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, nullif(l_linenumber, 3))",
)
def agg_dup_rows(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", F.expr("nullif(l_linenumber, 3)").alias("line"))
    return aggregates.duplicates(lines, ["l_orderkey", "line"]).select("duplicate_rows")


@demo(
    "agg_sum_tot",
    """
    SELECT round(coalesce(sum(l_extendedprice), 0), 2) AS total,
           round(coalesce(sum(CASE WHEN l_quantity < 0 THEN l_extendedprice END), 0), 2) AS empty_total
    FROM lineitem
    """,
)
def agg_sum_tot(spark, d):
    def total(value):
        return F.round(F.coalesce(F.sum(value), F.lit(0.0)), 2)

    return t(spark, d, "lineitem").agg(
        total(F.col("l_extendedprice")).alias("total"),
        total(filters.conditional("l_quantity < 0", "l_extendedprice")).alias("empty_total"),
    )


@demo(
    "agg_minmaxavg",
    "SELECT min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events",
)
def agg_minmaxavg(spark, d):
    return t(spark, d, "events").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean")
    )


@demo(
    "agg_distinct_vals",
    """
    SELECT 'status' AS column_name, count(*) AS distinct_values FROM (SELECT DISTINCT nullif(o_orderstatus, 'P') FROM orders)
    UNION ALL
    SELECT 'priority', count(*) FROM (SELECT DISTINCT o_orderpriority FROM orders)
    """,
)
def agg_distinct_vals(spark, d):
    orders = t(spark, d, "orders").select(
        F.expr("nullif(o_orderstatus, 'P')").alias("status"), F.col("o_orderpriority").alias("priority")
    )
    return aggregates.distinct_values(orders, ["status", "priority"])


@demo(
    "agg_count_distinct",
    """
    SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1
    """,
)
def agg_count_distinct(spark, d):
    return t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count_distinct("o_custkey").alias("customers")
    )


@demo(
    "agg_count_distinct_approx",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_custkey) AS customers, TRUE AS within_three_errors FROM orders GROUP BY 1",
)
def agg_count_distinct_approx(spark, d):
    """The sketch's estimate held against the exact count, at its relative standard error of 2 %."""
    error = 0.02
    exact, estimate = F.count_distinct("o_custkey"), F.approx_count_distinct("o_custkey", error)
    return t(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        exact.alias("customers"), (F.abs(estimate - exact) <= F.greatest(3 * error * exact, F.lit(1))).alias("within_three_errors")
    )


def _event_days(spark, d):
    """Daily sketches of the events, stored and read back."""
    path = scratch_path(spark, "sketches")
    events = t(spark, d, "events")
    sketches.store_days(sketches.daily_sketches(events, F.col("ts"), ["event_type"], {"users": F.col("user_id")}, {"value": F.col("value")}), path)
    return sketches.stored_days(spark, path)


@demo(
    "agg_sketch_distinct",
    """
    SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS rows, count(DISTINCT user_id) AS users, TRUE AS within_three_errors FROM events GROUP BY ALL
    """,
)
def agg_sketch_distinct(spark, d):
    """Monthly users merged from stored daily sketches, held against the exact count."""
    month = F.date_format("day", "yyyy-MM").alias("month")
    estimate = sketches.merged(_event_days(spark, d), [month, "event_type"])
    exact = t(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count_distinct("user_id").alias("users"))
    error = F.greatest(3 * sketches.DISTINCT_ERROR * F.col("users"), F.lit(1))
    return exact.join(estimate, ["month", "event_type"]).select(
        "month", "event_type", "rows", "users", (F.abs(F.col("distinct_users") - F.col("users")) <= error).alias("within_three_errors")
    )


@demo(
    "agg_sketch_percentile",
    "SELECT event_type, count(*) AS rows, TRUE AS p50_within, TRUE AS p95_within FROM events GROUP BY 1",
)
def agg_sketch_percentile(spark, d):
    """Percentiles merged from stored daily sketches: the true ranks of the estimates are within the stated error."""
    ranks = {"p50": 0.5, "p95": 0.95}
    estimate = sketches.merged(_event_days(spark, d), ["event_type"], ranks)
    placed = t(spark, d, "events").join(estimate.drop("rows"), "event_type")
    held = []
    for name, rank in ranks.items():
        below, upto = (F.avg(F.when(test, 1.0).otherwise(0.0)) for test in (F.col("value") < F.col(f"values_value_{name}"), F.col("value") <= F.col(f"values_value_{name}")))
        held.append(((below <= rank + sketches.QUANTILE_ERROR) & (upto >= rank - sketches.QUANTILE_ERROR)).alias(f"{name}_within"))
    return placed.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), *held)


@demo("agg_avg", "SELECT o_custkey, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1")
def agg_avg(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 6).alias("mean"))


@demo(
    "agg_ratio_sums",
    """
    SELECT l_suppkey, round(sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0), 8) AS ratio
    FROM lineitem GROUP BY 1
    """,
)
def agg_ratio_sums(spark, d):
    ratio = F.try_divide(F.sum(F.col("l_extendedprice") * F.col("l_discount")), F.sum("l_extendedprice"))
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(ratio, 8).alias("ratio"))


@demo(
    "agg_ratio_cond",
    """
    SELECT c_mktsegment, round(count(*) FILTER (WHERE c_acctbal < 0)::DOUBLE / count(*), 8) AS share
    FROM customer GROUP BY 1
    """,
)
def agg_ratio_cond(spark, d):
    return t(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(share_of(F.col("c_acctbal") < 0), 8).alias("share"))


@demo(
    "agg_net",
    """
    SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS month,
           round(sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END)
               - sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS net
    FROM lineitem GROUP BY 1, 2
    """,
)
def agg_net(spark, d):
    plus = F.sum(filters.conditional("l_returnflag <> 'R'", "l_extendedprice", 0.0))
    minus = F.sum(filters.conditional("l_returnflag = 'R'", "l_extendedprice", 0.0))
    return t(spark, d, "lineitem").groupBy("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        F.round(plus - minus, 2).alias("net")
    )


@demo(
    "agg_percentile",
    """
    SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
           round(quantile_cont(value, 0.99), 6) AS p99
    FROM events GROUP BY 1
    """,
)
def agg_percentile(spark, d):
    found = exact_percentiles(
        t(spark, d, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["event_type"]
    )
    return found.select("event_type", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


@demo(
    "agg_dist_pct",
    """
    SELECT event_type, count(*) AS rows, round(count(*)::DOUBLE / (SELECT count(*) FROM events) * 100, 1) AS share_pct
    FROM events GROUP BY 1
    """,
)
def agg_dist_pct(spark, d):
    return aggregates.category_shares(t(spark, d, "events"), "event_type")


@demo(
    "agg_any_all",
    """
    SELECT o_custkey, bool_or(o_totalprice > 400000) AS any_large, bool_and(o_totalprice > 1000) AS all_sizeable
    FROM orders GROUP BY 1
    """,
)
def agg_any_all(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(
        F.bool_or(F.col("o_totalprice") > 400000).alias("any_large"),
        F.bool_and(F.col("o_totalprice") > 1000).alias("all_sizeable"),
    )


@demo(
    "agg_macro_avg",
    """
    SELECT round(avg(s), 6) AS macro FROM
    (SELECT count(*) FILTER (WHERE l_returnflag = 'R') * 100.0::DOUBLE / count(*) AS s FROM lineitem GROUP BY l_suppkey)
    """,
)
def agg_macro_avg(spark, d):
    per_model = t(spark, d, "lineitem").groupBy("l_suppkey").agg(
        (share_of(F.col("l_returnflag") == "R") * 100.0).alias("s")
    )
    return per_model.agg(F.round(F.avg("s"), 6).alias("macro"))


# --- comparison ------------------------------------------------------------------------------

# the candidate has shifted prices of one status, lost one priority and blanks around texts
CANDIDATE = """
    SELECT o_orderkey, ' ' || o_orderstatus || ' ' AS o_orderstatus,
           o_totalprice + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0.00001 END AS o_totalprice
    FROM orders WHERE o_orderpriority <> '5-LOW'
"""


def _sides(spark, d):
    orders = t(spark, d, "orders")
    base = orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    shift = F.when(F.col("o_orderstatus") == "P", F.lit(1.0)).otherwise(F.lit(0.00001))
    candidate = orders.where("o_orderpriority <> '5-LOW'").select(
        (F.col("o_totalprice") + shift).alias("o_totalprice"),
        "o_orderkey",
        F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")).alias("o_orderstatus"),
    )
    return base, candidate


@demo(
    "cmp_multiset",
    f"""
    WITH a AS (SELECT o_orderkey, trim(o_orderstatus) AS s, round(o_totalprice, 4) AS p FROM orders),
         b AS (SELECT o_orderkey, trim(o_orderstatus) AS s, round(o_totalprice, 4) AS p FROM ({CANDIDATE})),
         l AS (SELECT count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)),
         r AS (SELECT count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
    SELECT l.n AS only_base, r.n AS only_other, l.n = 0 AND r.n = 0 AS equal FROM l, r
    """,
)
def cmp_multiset(spark, d):
    return compare.multiset_difference(*_sides(spark, d))


@demo(
    "cmp_strict",
    f"""
    WITH a AS (SELECT o_orderkey, o_orderstatus AS s, o_totalprice AS p FROM orders),
         b AS (SELECT o_orderkey, o_orderstatus AS s, o_totalprice AS p FROM ({CANDIDATE})),
         l AS (SELECT count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)),
         r AS (SELECT count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
    SELECT l.n AS only_base, r.n AS only_other, l.n = 0 AND r.n = 0 AS equal FROM l, r
    """,
)
def cmp_strict(spark, d):
    return compare.strict_difference(*_sides(spark, d))


@demo(
    "cmp_strict_wide",
    """
    SELECT count(*) FILTER (o_orderkey % 2 = 1) AS only_base, count(*) FILTER (o_orderkey % 2 = 1) AS only_other, FALSE AS equal FROM orders
    """,
)
def cmp_strict_wide(spark, d):
    """Keys above 2 ** 53, which doubles do not tell apart, against decimals that differ in the last digit of every other row."""
    orders = t(spark, d, "orders")
    key = (F.col("o_orderkey") * 4 + F.lit(2**53)).cast("bigint")
    odd = F.col("o_orderkey") % 2
    return compare.strict_difference(orders.select(key.alias("k")), orders.select((key + odd).cast("decimal(30,0)").alias("k")))


@demo(
    "cmp_variance",
    """
    WITH a AS (SELECT l_returnflag, count(*) AS n, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1),
         b AS (SELECT l_returnflag, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS p FROM lineitem GROUP BY 1),
         s AS (SELECT (SELECT count(*) FROM a) AS ra, (SELECT count(*) FROM b) AS rb,
                      (SELECT sum(n) + sum(p) FROM a) AS ta, (SELECT sum(n) + sum(p) FROM b) AS tb)
    SELECT ra AS base_rows, rb AS other_rows, rb - ra AS row_delta,
           round(abs(tb - ta) / abs(ta) * 100, 4) AS variance_pct,
           ra = rb AND abs(tb - ta) / abs(ta) * 100 < 0.001 AS equal
    FROM s
    """,
)
def cmp_variance(spark, d):
    lines = t(spark, d, "lineitem")
    base = lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("p"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    other = lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(net).alias("p"))
    return compare.variance(base, other)


@demo(
    "cmp_cellwise",
    """
    WITH a AS (SELECT l_suppkey, nullif(l_returnflag, 'A') AS f, round(sum(l_quantity), 4) AS q FROM lineitem
               WHERE l_linenumber < 7 GROUP BY 1, 2),
         b AS (SELECT l_suppkey, nullif(l_returnflag, 'A') AS f, round(sum(l_quantity), 4) AS q FROM lineitem
               WHERE l_discount < 0.1 AND l_suppkey % 3 <> 0 GROUP BY 1, 2)
    SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey,
           CASE WHEN a.l_suppkey IS NOT NULL THEN a.f ELSE b.f END AS f,
           a.q AS q_base, b.q AS q_other, (a.l_suppkey IS NOT NULL)::BIGINT AS rows_base, CASE WHEN b.l_suppkey IS NULL THEN 0 WHEN b.l_suppkey % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS rows_other,
           CASE WHEN b.l_suppkey % 5 = 0 THEN 'repeated' WHEN a.l_suppkey IS NULL THEN 'added' WHEN b.l_suppkey IS NULL THEN 'removed'
                WHEN a.q IS NOT DISTINCT FROM b.q THEN 'same' ELSE 'changed' END AS change
    FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.f IS NOT DISTINCT FROM b.f
    """,
)
def cmp_cellwise(spark, d):
    lines = t(spark, d, "lineitem").withColumn("f", F.expr("nullif(l_returnflag, 'A')"))
    base = lines.where("l_linenumber < 7").groupBy("l_suppkey", "f").agg(F.sum("l_quantity").alias("q"))
    other = lines.where("l_discount < 0.1 AND l_suppkey % 3 <> 0").groupBy("l_suppkey", "f").agg(
        F.sum("l_quantity").alias("q")
    )
    return compare.cellwise(base, other.unionByName(other.where("l_suppkey % 5 = 0")), ["l_suppkey", "f"], ["q"])


CORRECTED = """
    SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity + CASE WHEN l_orderkey % 977 = 5 AND l_linenumber = 2 THEN 1 ELSE 0 END AS l_quantity,
           nullif(l_returnflag, 'A') AS f FROM lineitem WHERE NOT (l_orderkey % 1499 = 7 AND l_linenumber = 1)
"""


def _corrected(spark, d):
    """Lineitem, and a copy in which few lines have another quantity and few are gone."""
    lines = t(spark, d, "lineitem").withColumn("f", F.expr("nullif(l_returnflag, 'A')"))
    names = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "f"]
    more = F.when((F.col("l_orderkey") % 977 == 5) & (F.col("l_linenumber") == 2), 1).otherwise(0)
    other = lines.where("NOT (l_orderkey % 1499 = 7 AND l_linenumber = 1)").withColumn("l_quantity", F.col("l_quantity") + more)
    return lines.select(*names), other.select(*names)


@demo(
    "cmp_tree",
    f"""
    WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, nullif(l_returnflag, 'A') AS f FROM lineitem), b AS ({CORRECTED}),
         l AS (SELECT count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)),
         r AS (SELECT count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
    SELECT l.n AS only_base, r.n AS only_other, l.n = 0 AND r.n = 0 AS equal FROM l, r
    """,
)
def cmp_tree(spark, d):
    return compare.tree_difference(*_corrected(spark, d))


@demo(
    "cmp_tree_cells",
    f"""
    WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem), b AS (SELECT * EXCLUDE (f) FROM ({CORRECTED})),
         x AS (SELECT l_orderkey, l_linenumber, l_suppkey, count(*) AS n, max(l_quantity) AS q, list_sort(list(l_quantity)) AS all_q FROM a GROUP BY ALL),
         y AS (SELECT l_orderkey, l_linenumber, l_suppkey, count(*) AS n, max(l_quantity) AS q, list_sort(list(l_quantity)) AS all_q FROM b GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, l_suppkey, x.q AS l_quantity_base, y.q AS l_quantity_other, coalesce(x.n, 0) AS rows_base, coalesce(y.n, 0) AS rows_other,
           CASE WHEN greatest(x.n, y.n) > 1 THEN 'repeated' WHEN x.n IS NULL THEN 'added' WHEN y.n IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM x FULL JOIN y USING (l_orderkey, l_linenumber, l_suppkey) WHERE x.all_q IS DISTINCT FROM y.all_q
    """,
)
def cmp_tree_cells(spark, d):
    return compare.tree_cellwise(*_corrected(spark, d), ["l_orderkey", "l_linenumber", "l_suppkey"], ["l_quantity"])


@demo(
    "cmp_fingerprint",
    """
    WITH c AS (SELECT o_custkey::VARCHAR AS a, o_orderkey::VARCHAR AS b, trim(o_orderstatus) AS s FROM orders),
         h AS (SELECT sha256(coalesce(length(a) || ':' || a, '-') || coalesce(length(b) || ':' || b, '-') || coalesce(length(s) || ':' || s, '-')) AS h FROM c),
         w AS (SELECT count(*) AS rows, sum(('0x' || h[1:8])::BIGINT) AS w0, sum(('0x' || h[9:16])::BIGINT) AS w1,
                      sum(('0x' || h[17:24])::BIGINT) AS w2, sum(('0x' || h[25:32])::BIGINT) AS w3 FROM h)
    SELECT rows, sha256(concat_ws('|', rows::VARCHAR, w0::VARCHAR, w1::VARCHAR, w2::VARCHAR, w3::VARCHAR)) AS fingerprint
    FROM w
    """,
)
def cmp_fingerprint(spark, d):
    return compare.fingerprint(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


# --- contrast of a table ---------------------------------------------------------------------


def _profiled(spark, d):
    return t(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "active").otherwise(F.col("o_orderstatus")).alias("status"),
        F.col("o_orderpriority").alias("category"),
        F.lit("web").alias("channel"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_custkey").alias("customer_id"),
    )


def _contrast_sql(*names: str) -> str:
    checks = {
        "volume": "SELECT 'volume' AS check_name, CASE WHEN count(*) >= 3 THEN 'PASS' ELSE 'WARN' END AS status, "
        "count(*)::DOUBLE AS observed FROM orders",
        "status": "SELECT 'status', CASE WHEN count(DISTINCT o_orderstatus) > 1 AND bool_or(o_orderstatus <> 'F') "
        "THEN 'PASS' ELSE 'FAIL' END, count(*) FILTER (WHERE o_orderstatus <> 'F')::DOUBLE FROM orders",
        "category": "SELECT 'category_category', CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'PASS' ELSE 'WARN' END, "
        "CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM orders",
        "channel": "SELECT 'category_channel', 'WARN', 0.0::DOUBLE FROM orders HAVING count(*) > 0",
        "numeric": "SELECT 'numeric_amount', CASE WHEN min(o_totalprice) <> max(o_totalprice) THEN 'PASS' ELSE 'WARN' END, "
        "round(avg(o_totalprice), 2) FROM orders",
        "grain": "SELECT 'grain_customer_id', CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'WARN' END, count(*)::DOUBLE FROM "
        "(SELECT 1 FROM orders GROUP BY o_custkey HAVING count(*) > 1)",
    }
    first = "SELECT check_name, status, observed FROM (SELECT NULL AS check_name, NULL AS status, NULL::DOUBLE AS observed) WHERE FALSE"
    return " UNION ALL ".join([first, *[checks[n] for n in names]])


def _one_check(spark, d, roles, name):
    return contrast.profile_contrast(_profiled(spark, d), roles).where(F.col("check_name") == name)


@demo("pf_volume", _contrast_sql("volume"))
def pf_volume(spark, d):
    return contrast.profile_contrast(_profiled(spark, d), contrast.Roles())


@demo("pf_status", _contrast_sql("status"))
def pf_status(spark, d):
    return _one_check(spark, d, contrast.Roles(status="status"), "status")


@demo("pf_category", _contrast_sql("category", "channel"))
def pf_category(spark, d):
    roles = contrast.Roles(categories=("category", "channel"))
    return contrast.profile_contrast(_profiled(spark, d), roles).where(F.col("check_name") != "volume")


@demo("pf_numeric", _contrast_sql("numeric"))
def pf_numeric(spark, d):
    return _one_check(spark, d, contrast.Roles(numeric="amount"), "numeric_amount")


@demo("pf_grain", _contrast_sql("grain"))
def pf_grain(spark, d):
    return _one_check(spark, d, contrast.Roles(key="customer_id"), "grain_customer_id")


@demo(
    "pf_score",
    f"""
    SELECT count(*) AS checks, count(*) FILTER (WHERE status = 'PASS') AS passed_checks,
           round(count(*) FILTER (WHERE status = 'PASS')::DOUBLE / count(*) * 100, 1) AS score_pct,
           round(count(*) FILTER (WHERE status = 'PASS')::DOUBLE / count(*) * 100, 1) >= 70 AS adequate
    FROM ({_contrast_sql("volume", "status", "category", "channel", "numeric", "grain")})
    """,
)
def pf_score(spark, d):
    return contrast.contrast_score(contrast.profile_contrast(_profiled(spark, d)))


# --- sinks, written and read back ------------------------------------------------------------


@demo("snk_jsonl", "SELECT event_id, user_id, event_type, TRUE AS redacted FROM events")
def snk_jsonl(spark, d):
    path = scratch_path(spark, "jsonl")
    sinks.write_jsonl(t(spark, d, "events").drop("ts", "value"), path, raw=("props",))
    lines = spark.read.text(path)
    held = lines.select(F.from_json("value", "event_id bigint, user_id bigint, event_type string, props string").alias("r"), "value")
    return held.select("r.event_id", "r.user_id", "r.event_type", (~F.contains("value", F.lit('"props"'))).alias("redacted"))


@demo(
    "snk_artifacts",
    "SELECT DISTINCT sha256(trim(text, ' ')) AS sql_hash, trim(text, ' ') AS sql FROM conversations WHERE text IS NOT NULL",
)
def snk_artifacts(spark, d):
    """Written in two parts of which the second holds all texts again: each is stored once."""
    path = scratch_path(spark, "artifacts")
    talk = t(spark, d, "conversations")
    sinks.write_artifacts(talk.where("conv_id % 2 = 0"), "text", path)
    sinks.write_artifacts(talk, "text", path)
    return spark.read.parquet(path)
