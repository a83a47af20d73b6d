"""Scoring of evaluated variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.demos import derived
from plumbline.demos.metrics import NET_REVENUE, NET_REVENUE_SQL, order_lines
from plumbline.demos.registry import demo
from plumbline.functions.stats import wilson_interval
from plumbline.operators import assertions as A
from plumbline.operators import scoring
from plumbline.operators.governance import check_compliance
from plumbline.operators.suites import Suite
from plumbline.plans.variants import BASE, derive, run_variants
from plumbline.session import scratch_path, stored
from plumbline.sources import sinks
from plumbline.sources.tables import read_table as t

E = derived.EVALUATIONS


def _classified(spark, d):
    return scoring.classify(derived.evaluations(spark, d))


@demo(
    "hs_classify",
    f"WITH {E} SELECT suite, operator, classification, count(*) AS variants FROM evaluations GROUP BY ALL",
)
def hs_classify(spark, d):
    return _classified(spark, d).groupBy("suite", "operator", "classification").agg(F.count(F.lit(1)).alias("variants"))


CATCH = f"""
    {E},
    scores AS (
      SELECT model, track, suite, count(*) AS generated,
             count(*) FILTER (WHERE classification = 'EQUIVALENT_ON_FIXTURE') AS equivalent,
             count(*) FILTER (WHERE classification = 'RUNTIME_ERROR') AS unexecutable,
             count(*) FILTER (WHERE classification = 'VALID_DEFECT_DETECTED') AS detected,
             count(*) FILTER (WHERE classification = 'VALID_DEFECT_SURVIVED') AS surviving,
             count(*) FILTER (WHERE classification LIKE 'VALID%') AS valid_defects,
             round(count(*) FILTER (WHERE classification = 'VALID_DEFECT_DETECTED')::DOUBLE
                   / nullif(count(*) FILTER (WHERE classification LIKE 'VALID%'), 0) * 100, 1) AS effective_catch_pct
      FROM evaluations GROUP BY ALL)"""


def _scores(spark, d):
    return scoring.catch_scores(_classified(spark, d), ["model", "track", "suite"])


@demo("hs_catch", f"WITH {CATCH} SELECT * FROM scores")
def hs_catch(spark, d):
    return _scores(spark, d)


GAIN = f"""
    {CATCH},
    gain AS (SELECT s.model, s.track, s.effective_catch_pct AS standard_catch_pct, m.effective_catch_pct AS semantic_catch_pct,
                    round(m.effective_catch_pct - s.effective_catch_pct, 1) AS incremental_gain_pct
             FROM scores s JOIN scores m ON s.model = m.model AND s.suite = 'standard' AND m.suite = 'semantic')"""


@demo("hs_gain", f"WITH {GAIN} SELECT * FROM gain")
def hs_gain(spark, d):
    return scoring.incremental_gain(_scores(spark, d), "standard", "semantic", ["model", "track"])


@demo(
    "jn_pair",
    f"""
    WITH {E} SELECT s.classification AS standard_outcome, m.classification AS semantic_outcome, count(*) AS variants
    FROM evaluations s JOIN evaluations m ON s.model = m.model AND s.variant_id = m.variant_id AND s.operator = m.operator
         AND s.suite = 'standard' AND m.suite = 'semantic'
    GROUP BY ALL
    """,
)
def jn_pair(spark, d):
    pairs = scoring.pair_suites(_classified(spark, d), "standard", "semantic", ["model", "variant_id", "operator"])
    return pairs.groupBy("standard_outcome", "semantic_outcome").agg(F.count(F.lit(1)).alias("variants"))


GRADED = f"""
    {GAIN},
    inputs AS (SELECT model, round(count(DISTINCT operator) * 12.5::DOUBLE, 1) AS fixture_adequacy_pct,
                      round(avg(variance_pct) * 10, 1) AS contract_coverage_pct FROM shared GROUP BY 1),
    graded AS (
      SELECT g.*, fixture_adequacy_pct, contract_coverage_pct,
             CASE WHEN fixture_adequacy_pct >= 80 AND contract_coverage_pct >= 60 THEN 'CONCLUSIVE'
                  WHEN fixture_adequacy_pct >= 60 AND contract_coverage_pct >= 40 THEN 'QUALIFIED' ELSE 'INCONCLUSIVE' END AS validity,
             CASE WHEN fixture_adequacy_pct >= 80 AND contract_coverage_pct >= 60 THEN 'HIGH'
                  WHEN fixture_adequacy_pct >= 60 AND contract_coverage_pct >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
      FROM gain g JOIN inputs USING (model))"""


def _graded(spark, d):
    inputs = derived.evaluations(spark, d).where("suite = 'standard'").groupBy("model").agg(
        F.round(F.count_distinct("operator") * 12.5, 1).alias("fixture_adequacy_pct"),
        F.round(F.avg("variance_pct") * 10, 1).alias("contract_coverage_pct"),
    )
    gains = scoring.incremental_gain(_scores(spark, d), "standard", "semantic", ["model", "track"])
    return scoring.grade(gains.join(inputs, "model"))


@demo("hs_validity", f"WITH {GRADED} SELECT * FROM graded")
def hs_validity(spark, d):
    return _graded(spark, d)


def _wilson_sql(success, trials):
    z = 1.959963984540054
    p = f"({success})::DOUBLE / {trials}"
    centre = f"{p} + {z * z} / (2.0 * {trials})"
    spread = f"{z} * sqrt({p} * (1 - {p}) / {trials} + {z * z} / (4.0 * {trials} * {trials}))"
    scale = f"(1 + {z * z} / {trials})"
    return f"({centre} - {spread}) / {scale}", f"({centre} + {spread}) / {scale}"


LOW, HIGH = _wilson_sql("sum(detected)", "sum(valid_defects)")


@demo(
    "hs_track",
    f"""
    WITH {GRADED}
    SELECT track, count(*) AS models, round(avg(effective_catch_pct), 1) AS macro_catch_pct, sum(detected)::BIGINT AS detected,
           sum(valid_defects)::BIGINT AS valid_defects, count(*) FILTER (WHERE validity = 'CONCLUSIVE') AS certified,
           round(sum(detected)::DOUBLE / sum(valid_defects) * 100, 1) AS pooled_catch_pct,
           round({LOW} * 100, 1) AS wilson_low_pct, round({HIGH} * 100, 1) AS wilson_high_pct
    FROM scores JOIN (SELECT model, validity FROM graded) USING (model) WHERE suite = 'semantic' GROUP BY track
    """,
)
def hs_track(spark, d):
    scores = _scores(spark, d).where("suite = 'semantic'")
    return scoring.track_summary(scores.join(_graded(spark, d).select("model", "validity"), "model"))


LOW_1, HIGH_1 = _wilson_sql("count(*) FILTER (WHERE l_returnflag = 'R')", "count(*)")


@demo(
    "hs_wilson",
    f"SELECT l_suppkey, round({LOW_1}, 8) AS low, round({HIGH_1}, 8) AS high FROM lineitem GROUP BY 1",
)
def hs_wilson(spark, d):
    counts = t(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("hits"), F.count(F.lit(1)).alias("n")
    )
    low, high = wilson_interval(F.col("hits"), F.col("n"))
    return counts.select("l_suppkey", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@demo(
    "hs_false_pos",
    f"""
    WITH {E} SELECT suite, count(*) FILTER (WHERE classification = 'EQUIVALENT_ON_FIXTURE') AS equivalent,
         count(*) FILTER (WHERE classification = 'EQUIVALENT_ON_FIXTURE' AND n_failed > 0) AS flagged,
         round(count(*) FILTER (WHERE classification = 'EQUIVALENT_ON_FIXTURE' AND n_failed > 0)::DOUBLE
             / nullif(count(*) FILTER (WHERE classification = 'EQUIVALENT_ON_FIXTURE'), 0), 8) AS false_positive_rate
    FROM evaluations GROUP BY 1
    """,
)
def hs_false_pos(spark, d):
    return scoring.false_positives(_classified(spark, d), ["suite"]).withColumn(
        "false_positive_rate", F.round("false_positive_rate", 8)
    )


@demo(
    "hs_tier1",
    """
    SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderkey IS NULL) + count(*) FILTER (WHERE nullif(o_orderstatus, 'P') IS NULL)
           + count(*) FILTER (WHERE o_custkey IS NULL) AS null_cells,
           count(*) > 0 AND count(*) FILTER (WHERE nullif(o_orderstatus, 'P') IS NULL) = 0 AS passed
    FROM orders
    """,
)
def hs_tier1(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("status"), "o_custkey")
    return scoring.minimal_structural(orders)


@demo(
    "hs_survivors",
    f"""
    WITH {E},
    taxonomy AS (SELECT * FROM (VALUES ('ad_campaign_roas', 'BOUNDARY_SHIFT', 'MISSING_CONTRACT'), ('hospital_readmission_rate', 'FILTER_DROP', 'MISSING_CONTRACT'),
        ('marketplace_take_rate', 'AGGREGATION_SWAP', 'ASSERTION_GAP'), ('fintech_chargeback_rate', 'COALESCE_BYPASS', 'MUTATION_ORACLE_GAP')) v(model, operator, root_cause_category)),
    named AS (SELECT *, (['ad_campaign_roas', 'hospital_readmission_rate', 'marketplace_take_rate', 'fintech_chargeback_rate', 'net_revenue'])
                        [(replace(model, 'model_', '')::BIGINT % 5 + 1)::INT] AS metric FROM evaluations)
    SELECT n.metric AS model, n.operator, x.root_cause_category, count(*) AS survivors
    FROM named n LEFT JOIN taxonomy x ON n.metric = x.model AND n.operator = x.operator
    WHERE classification = 'VALID_DEFECT_SURVIVED' GROUP BY ALL
    """,
)
def hs_survivors(spark, d):
    names = ("ad_campaign_roas", "hospital_readmission_rate", "marketplace_take_rate", "fintech_chargeback_rate", "net_revenue")
    number = F.replace("model", F.lit("model_"), F.lit("")).cast("bigint")
    named = _classified(spark, d).withColumn("model", F.get(F.array(*map(F.lit, names)), (number % 5).cast("int")))
    found = scoring.explain_survivors(named, scoring.survivor_taxonomy(spark))
    return found.groupBy("model", "operator", "root_cause_category").agg(F.count(F.lit(1)).alias("survivors"))


def _suites():
    standard = Suite(
        "standard",
        [
            A.NotNull("nulls", ("customer_id", "reporting_month", "net_revenue")),
            A.Unique("unique", ("customer_id", "reporting_month")),
            A.RowCount("rows", 1),
        ],
    )
    semantic = Suite(
        "semantic",
        [
            A.Grain("grain", ("customer_id", "reporting_month")),
            A.Population("finished", "orders", "o_orderstatus = 'F'", "customer_id"),
            A.AcceptedRange("plausible", "net_revenue", -250000.0, 250000.0),
        ],
    )
    return [standard, semantic]


def net_revenue_kill_matrix(spark, d):
    orders = t(spark, d, "orders").withColumnRenamed("o_custkey", "customer_id")
    return scoring.kill_matrix(NET_REVENUE, order_lines(spark, d), _suites(), {"orders": orders})


def _matrix_ctes():
    """m: the variants' rows; checks: what each assertion that can object says."""
    base = "l_linestatus = 'O' AND o_orderstatus = 'F'"

    def one(label, where, sign="-", swap=False, grain=False):
        inner = NET_REVENUE_SQL.format(where=where).replace("- sum", f"{sign} sum")
        if swap:
            inner = inner.replace("sum(CASE WHEN l_returnflag <> 'R'", "avg(CASE WHEN l_returnflag <> 'R'")
        if grain:
            inner = f"SELECT customer_id, NULL AS reporting_month, sum(net_revenue) AS net_revenue FROM ({inner}) GROUP BY ALL"
        return f"SELECT '{label}' AS variant, customer_id, reporting_month, round(net_revenue, 4) AS v FROM ({inner})"

    parts = [
        one("BASE", base),
        one("FILTER_DROP", "l_linestatus = 'O'"),
        one("BOUNDARY_SHIFT", "l_linestatus != 'O' AND o_orderstatus = 'F'"),
        one("AGGREGATION_SWAP", base, swap=True),
        one("GRAIN_DROP", base, grain=True),
        one("MATH_OPERATOR_INVERT", base, sign="+"),
    ]
    return f"""
    m AS ({" UNION ALL ".join(parts)}),
    b AS (SELECT count(*) AS n FROM m WHERE variant = 'BASE'),
    bad AS (SELECT o_custkey AS customer_id, count(*) AS c FROM orders WHERE NOT (o_orderstatus = 'F') GROUP BY 1),
    diffs AS (SELECT variant, count(*) AS variant_rows FROM m WHERE variant <> 'BASE' GROUP BY 1),
    checks AS (
      SELECT variant, 'standard' AS suite, 'nulls' AS name, count(*) FILTER (WHERE reporting_month IS NULL) > 0 AS failed FROM m GROUP BY 1
      UNION ALL SELECT variant, 'semantic', 'plausible', count(*) FILTER (WHERE abs(v) > 250000) > 0 FROM m GROUP BY 1
      UNION ALL SELECT variant, 'semantic', 'finished', count(*) > 0 FROM m JOIN bad USING (customer_id) GROUP BY 1)"""


def _kill_sql():
    return f"""
    WITH {_matrix_ctes()},
    failed AS (SELECT variant, suite, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE failed), '') AS assertions_failed FROM checks GROUP BY 1, 2)
    SELECT 'net_revenue' AS model, suite, variant AS operator, b.n AS base_rows, variant_rows, assertions_failed,
           CASE WHEN assertions_failed <> '' THEN 'VALID_DEFECT_DETECTED' ELSE 'VALID_DEFECT_SURVIVED' END AS classification
    FROM diffs JOIN failed USING (variant), b
    """


@demo("hs_kill_matrix", _kill_sql())
def hs_kill_matrix(spark, d):
    return net_revenue_kill_matrix(spark, d).select(
        "model",
        "suite",
        "operator",
        "base_rows",
        "variant_rows",
        F.array_join("assertions_failed", ",").alias("assertions_failed"),
        "classification",
    )


def _results(spark, d):
    """The variants of one metric, and both suites run on each."""
    source = order_lines(spark, d)
    variants = [v for v in derive(NET_REVENUE, source) if v.error is None]
    long = stored(run_variants(NET_REVENUE, source, store=True), "long-net-revenue")
    orders = t(spark, d, "orders").withColumnRenamed("o_custkey", "customer_id")
    return variants, long, scoring.assertion_results(long, _suites(), {"orders": orders}, [v.fault for v in variants])


@demo(
    "hs_checks",
    f"""
    WITH {_matrix_ctes()}
    SELECT variant AS operator, TRUE AS volume_ok, bool_and(NOT (name = 'nulls' AND failed)) AS nulls_ok, TRUE AS schema_ok,
           bool_and(NOT (name = 'plausible' AND failed)) AS freshness_ok, bool_and(NOT (name = 'finished' AND failed)) AS value_ok,
           bool_or(failed) AS caught, NOT bool_or(failed) AS blind_spot
    FROM checks WHERE variant <> 'BASE' GROUP BY variant
    """,
)
def hs_checks(spark, d):
    _, _, results = _results(spark, d)
    return scoring.check_matrix(results, ["variant"]).withColumnRenamed("variant", "operator")


@demo(
    "hs_ladder",
    f"""
    WITH {_matrix_ctes()},
    flags AS (SELECT variant, count(*) FILTER (customer_id IS NULL OR reporting_month IS NULL OR v IS NULL) = 0 AS tier1_ok,
                     variant NOT IN ('FILTER_DROP', 'BOUNDARY_SHIFT') AS contract_ok, count(*)::DOUBLE AS rows FROM m WHERE variant <> 'BASE' GROUP BY 1),
    suites AS (SELECT variant, bool_and(NOT (suite = 'standard' AND failed)) AS project_ok, bool_and(NOT (suite = 'semantic' AND failed)) AS semantic_ok FROM checks GROUP BY 1),
    verdicts AS (
      SELECT 0 AS tier, FALSE AS caught, rows FROM flags
      UNION ALL SELECT 1, NOT tier1_ok, rows FROM flags
      UNION ALL SELECT 2, NOT tier1_ok OR NOT project_ok, rows FROM flags JOIN suites USING (variant)
      UNION ALL SELECT 3, NOT contract_ok, rows FROM flags
      UNION ALL SELECT 4, NOT semantic_ok, rows FROM flags JOIN suites USING (variant))
    SELECT tier, count(*) FILTER (WHERE caught) AS caught, count(*) AS valid, round(count(*) FILTER (WHERE caught)::DOUBLE / count(*) * 100, 2) AS catch_rate_pct,
           round(quantile_cont(rows, 0.5), 2) AS p50_rows, round(quantile_cont(rows, 0.95), 2) AS p95_rows
    FROM verdicts GROUP BY 1
    """,
)
def hs_ladder(spark, d):
    """All tiers run on the variants; the cost that is ranked is the number of rows a verdict had to look at."""
    variants, long, results = _results(spark, d)
    long = long.where(F.col("variant") != BASE)
    structure = scoring.minimal_structural(long, ["variant"])
    clauses = [(v.fault, "net_revenue", [p.sql for p in v.spec.filters]) for v in variants]
    log = spark.createDataFrame(clauses, "variant string, metric_id string, where_conjuncts array<string>").withColumns(
        {"group_by": F.array().cast("array<string>"), "agg_calls": F.array().cast("array<string>"), "sql": F.lit(""), "timezone": F.lit("UTC")}
    )
    agreed = spark.createDataFrame(
        [("net_revenue", [p.sql for p in NET_REVENUE.filters])], "metric_id string, required_filters array<string>"
    )
    none = F.lit(None)
    agreed = agreed.withColumns(
        {c: none.cast("array<string>") for c in ("forbidden_filters", "required_dimensions", "positive_components", "negative_components")}
        | {c: none.cast("string") for c in ("required_function", "timezone")}
    )
    flags = scoring.tier_flags(results, structure, check_compliance(log, agreed), "standard", "semantic")
    judged = flags.join(structure.select("variant", F.col("rows").cast("double").alias("judged")), "variant")
    tiers = scoring.ladder(scoring.tier_verdicts(judged).select("tier", "caught", "judged"), "judged")
    return tiers.withColumnsRenamed({"p50_ms": "p50_rows", "p95_ms": "p95_rows"})


@demo(
    "snk_matrix",
    f"WITH {CATCH} SELECT model, suite, detected, valid_defects, effective_catch_pct FROM scores",
)
def snk_matrix(spark, d):
    path = scratch_path(spark, "matrix")
    sinks.write_matrix(_scores(spark, d), path)
    held = spark.read.schema(
        "model string, suite string, detected bigint, valid_defects bigint, effective_catch_pct double"
    ).json(path)
    return held
