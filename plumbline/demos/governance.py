"""Contract tables and query logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.demos import derived
from plumbline.demos.registry import demo
from plumbline.functions import text
from plumbline.operators import contracts as C
from plumbline.operators import drift as D
from plumbline.operators import governance as G
from plumbline.session import scratch_path
from plumbline.sources import documents, sinks
from plumbline.sources.tables import read_csv
from plumbline.sources.tables import read_table as t

V = derived.VIOLATIONS
LOG = derived.QUERY_LOG

# --- contract documents -------------------------------------------------------------------------


def contract_rows(spark, d):
    """One contract per part; some are malformed."""
    key, size = F.col("p_partkey"), F.col("p_size")
    domains = F.array(*[F.lit(x) for x in ("finance", "risk", "sales", "ops")])
    return t(spark, d, "part").select(
        F.when(key % 11 == 0, "bad metric!").otherwise(F.concat(F.lit("metric_"), key)).alias("metric"),
        F.when(key % 13 == 0, "urn:x").otherwise(
            F.concat(F.lit("urn:metrics:"), F.get(domains, (key % 4).cast("int")), F.lit(":metric_"), key)
        ).alias("urn"),
        F.when(key % 17 == 0, "v1").otherwise(F.concat_ws(".", F.lit("1"), size, F.lit("0"))).alias("version"),
        F.when(key % 19 == 0, " ").otherwise(F.col("p_brand")).alias("owner"),
        F.when(key % 23 != 0, F.lit("customer_month")).alias("grain"),
        F.lit("SELECT 1").alias("sql"),
        F.when(key % 7 == 0, "oracle").otherwise("duckdb").alias("dialect"),
        (key % 29 / 20.0).alias("min_rate"),
        (key % 31 / 30.0).alias("max_rate"),
        F.when(key % 3 == 0, F.create_map(F.lit("domain"), F.get(domains, (key % 4).cast("int")))).alias("metadata"),
        F.when(key % 2 == 0, F.array(F.lower("p_type"), F.lit("tag"))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )


CONTRACT_ROWS = """
    contracts AS (
      SELECT p_partkey AS k, p_size AS size, CASE WHEN p_partkey % 11 = 0 THEN 'bad metric!' ELSE 'metric_' || p_partkey END AS metric,
             (['finance', 'risk', 'sales', 'ops'])[(p_partkey % 4 + 1)::INT] AS home,
             CASE WHEN p_partkey % 3 = 0 THEN (['finance', 'risk', 'sales', 'ops'])[(p_partkey % 4 + 1)::INT]
                  WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE 'general' END AS domain
      FROM part)"""


@demo(
    "gv_validate_contracts",
    f"""
    WITH {CONTRACT_ROWS},
    reasons AS (
      SELECT k, metric, list_filter([CASE WHEN k % 19 = 0 THEN 'missing owner' END, CASE WHEN k % 23 = 0 THEN 'missing grain' END,
        CASE WHEN k % 11 = 0 THEN 'metric is no slug' END, CASE WHEN k % 13 = 0 THEN 'malformed urn' END,
        CASE WHEN k % 17 = 0 THEN 'malformed version' END, CASE WHEN k % 7 = 0 THEN 'unknown dialect' END,
        CASE WHEN k % 29 / 20.0 > 1 THEN 'min_rate outside [0, 1]' END,
        CASE WHEN k % 29 / 20.0::DOUBLE > k % 31 / 30.0::DOUBLE THEN 'rate bounds crossed' END], lambda x: x IS NOT NULL) AS r FROM contracts)
    SELECT metric, len(r) = 0 AS accepted, array_to_string(r, '; ') AS reasons FROM reasons
    """,
)
def gv_validate_contracts(spark, d):
    checked = C.validate_contracts(contract_rows(spark, d))
    return checked.select("metric", "accepted", F.array_join("reasons", "; ").alias("reasons"))


@demo("gv_list", f"WITH {CONTRACT_ROWS} SELECT metric, domain FROM contracts WHERE domain IN ('finance', 'promo', 'general', 'risk')")
def gv_list(spark, d):
    listed = C.list_metrics(contract_rows(spark, d), allowed=["finance", "promo", "general", "risk"])
    return listed.select("metric", "domain")


@demo(
    "gv_resolve",
    """
    WITH pages_ref AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'urn:metrics:' || split_part(split_part(url, '//', 2), '.', 1) || ':page_' || (page_id % 50)
                        ELSE 'metrics://contracts/' || split_part(split_part(url, '//', 2), '.', 1) || '/page_' || (page_id % 50) || '/1.'
                             || (page_id % 12) || '.0' || CASE WHEN page_id % 2 = 0 THEN '/invariants' ELSE '' END END AS ref,
                        split_part(split_part(url, '//', 2), '.', 1) AS domain, 'page_' || (page_id % 50) AS metric FROM pages),
    offered AS (SELECT DISTINCT domain, metric, page_id % 12 AS v FROM pages_ref WHERE page_id % 5 <> 0),
    latest AS (SELECT domain, metric, max(v) AS v FROM offered GROUP BY 1, 2),
    wanted AS (SELECT p.*, CASE WHEN p.page_id % 3 = 0 THEN l.v ELSE p.page_id % 12 END AS v
               FROM pages_ref p LEFT JOIN latest l USING (domain, metric))
    SELECT page_id, ref, domain, metric, '1.' || w.v || '.0' AS version,
           CASE WHEN page_id % 3 <> 0 AND page_id % 2 = 0 THEN 'invariants' END AS part,
           EXISTS (SELECT 1 FROM offered o WHERE o.domain = w.domain AND o.metric = w.metric AND o.v = w.v) AS resolved
    FROM wanted w
    """,
)
def gv_resolve(spark, d):
    page = F.col("page_id")
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("."), F.lit(1))
    pages = t(spark, d, "pages").select(
        "page_id",
        host.alias("domain"),
        F.concat(F.lit("page_"), page % 50).alias("metric"),
        F.concat_ws(".", F.lit("1"), page % 12, F.lit("0")).alias("version"),
    )
    offered = pages.where("page_id % 5 <> 0").select("domain", "metric", "version").distinct()
    urn = F.concat_ws(":", F.lit("urn:metrics"), "domain", "metric")
    uri = F.concat(
        F.concat_ws("/", F.lit("metrics://contracts"), "domain", "metric", "version"),
        F.when(page % 2 == 0, F.lit("/invariants")).otherwise(""),
    )
    references = pages.select("page_id", F.when(page % 3 == 0, urn).otherwise(uri).alias("ref_text"))
    return C.resolve(references, "ref_text", offered).withColumnRenamed("ref_text", "ref")


@demo(
    "gv_coverage",
    """
    WITH named AS (
      SELECT p_partkey, (['net_revenue', 'sla_compliance_rate', 'customer_retention_rate', 'other'])[(p_partkey % 4 + 1)::INT] AS metric,
             list_filter([CASE WHEN p_size % 2 = 0 THEN 'population' END, CASE WHEN p_size % 2 = 0 THEN 'exclusion_filter' END,
                          CASE WHEN p_size % 3 = 0 THEN 'grain' END, CASE WHEN p_size % 5 = 0 THEN 'aggregation' END,
                          CASE WHEN p_size % 7 = 0 THEN 'currency' END, CASE WHEN p_size % 4 = 0 THEN 'time' END,
                          CASE WHEN p_size % 4 = 0 THEN 'cohort_period' END, CASE WHEN p_size % 4 = 0 THEN 'clock_start' END], lambda x: x IS NOT NULL) AS declared
      FROM part),
    wanted AS (SELECT *, CASE metric WHEN 'net_revenue' THEN ['population', 'grain', 'aggregation', 'currency', 'time']
        WHEN 'sla_compliance_rate' THEN ['population', 'grain', 'clock_start', 'clock_stop', 'exclusion_filter']
        WHEN 'customer_retention_rate' THEN ['population', 'grain', 'cohort_period', 'returning_window', 'eligibility']
        ELSE ['population', 'grain', 'aggregation'] END AS required FROM named),
    scored AS (SELECT *, list_filter(required, lambda x: list_contains(declared, x)) AS s,
                      list_filter(required, lambda x: NOT list_contains(declared, x)) AS m FROM wanted)
    SELECT p_partkey, metric, array_to_string(list_sort(s), ',') AS satisfied, array_to_string(list_sort(m), ',') AS missing,
           round(len(s)::DOUBLE / len(required) * 100, 1) AS coverage_pct, round(len(s)::DOUBLE / len(required) * 100, 1) >= 75 AS comprehensive
    FROM scored
    """,
)
def gv_coverage(spark, d):
    size = F.col("p_size")
    names = F.array(*[F.lit(m) for m in ("net_revenue", "sla_compliance_rate", "customer_retention_rate", "other")])

    def texts(condition, value="x"):
        return F.when(condition, F.array(F.lit(value)))

    documents_ = t(spark, d, "part").select(
        "p_partkey",
        F.get(names, (F.col("p_partkey") % 4).cast("int")).alias("metric"),
        F.struct(
            F.struct(texts(size % 2 == 0).alias("required_filters"), texts(F.lit(False)).alias("forbidden_filters")).alias("population"),
            F.struct(texts(size % 3 == 0).alias("required_dimensions")).alias("grain"),
            F.struct(
                F.when(size % 5 == 0, F.lit("SUM")).alias("required_function"),
                texts(F.lit(False)).alias("positive_components"),
                texts(F.lit(False)).alias("negative_components"),
            ).alias("aggregation"),
            F.struct(F.when(size % 7 == 0, F.lit("USD")).alias("currency")).alias("units"),
            F.struct(
                F.when(size % 4 == 0, F.lit("UTC")).alias("timezone"), F.lit(None).cast("string").alias("period_grain")
            ).alias("time"),
        ).alias("invariants"),
    )
    declared = documents_.withColumn("declared", C.declared_dimensions(documents_))
    return C.coverage(declared).select(
        "p_partkey",
        "metric",
        F.array_join("satisfied", ",").alias("satisfied"),
        F.array_join("missing", ",").alias("missing"),
        "coverage_pct",
        "comprehensive",
    )


# --- compliance ----------------------------------------------------------------------------------


def _checked(spark, d):
    return G.check_compliance(derived.query_log(spark, d), derived.rules(spark, d))


def _violations(spark, d, rule):
    return G.violation_rows(_checked(spark, d)).where(F.col("rule") == rule).select("request_id", "expected")


def _violations_sql(rule):
    return f"WITH {V} SELECT request_id, expected FROM violations WHERE rule = '{rule}'"


@demo("gv_required_filters", _violations_sql("required_filters"))
def gv_required_filters(spark, d):
    return _violations(spark, d, "required_filters")


@demo("gv_forbidden_filters", _violations_sql("forbidden_filters"))
def gv_forbidden_filters(spark, d):
    return _violations(spark, d, "forbidden_filters")


@demo("gv_grain", _violations_sql("required_dimensions"))
def gv_grain(spark, d):
    return _violations(spark, d, "required_dimensions")


@demo(
    "gv_components",
    """
    SELECT conv_id, turn, NOT contains(lower(text), 'the') AS positive_missing, NOT contains(lower(text), 'est') AS negative_missing
    FROM conversations
    """,
)
def gv_components(spark, d):
    talk = G.with_canonical_clauses(t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("sql")))
    missing = lambda word, rule: F.size(G.component_violations(F.array(F.lit(word)), rule)) > 0
    return talk.select(
        "conv_id",
        "turn",
        missing("The", "positive_components").alias("positive_missing"),
        missing("EST", "negative_components").alias("negative_missing"),
    )


@demo("gv_timezone", _violations_sql("timezone"))
def gv_timezone(spark, d):
    return _violations(spark, d, "timezone")


@demo(
    "gv_compliance",
    f"""
    WITH {V}, per AS (SELECT request_id, string_agg(rule || ':' || expected, ';' ORDER BY rule || ':' || expected) AS v, count(*) AS n
                      FROM violations GROUP BY 1)
    SELECT q.request_id, metric_id <> 'error' AS known_metric, metric_id <> 'error' AND coalesce(n, 0) = 0 AS passed,
           CASE WHEN metric_id = 'error' THEN 0 WHEN metric_id = 'view' THEN 3 ELSE 4 END::BIGINT AS rules_checked, coalesce(v, '') AS violations
    FROM query_log q LEFT JOIN per USING (request_id)
    """,
)
def gv_compliance(spark, d):
    labels = F.transform("violations", lambda v: F.concat_ws(":", v["rule"], v["expected"]))
    return _checked(spark, d).select(
        "request_id",
        "known_metric",
        "passed",
        F.col("rules_checked").cast("bigint").alias("rules_checked"),
        F.array_join(F.array_sort(labels), ";").alias("violations"),
    )


@demo(
    "gv_norm_predicates",
    """
    SELECT o_orderkey, o_orderpriority <> '5-LOW' AS same_population, o_orderstatus <> 'P' AS same_choice,
           o_orderpriority = '5-LOW' AS same_quoted, o_orderstatus <> 'F' AS same_nested
    FROM orders
    """,
)
def gv_norm_predicates(spark, d):
    low, status = F.col("o_orderpriority") == "5-LOW", F.col("o_orderstatus")
    left = F.array(F.lit("status = 'active'"), F.lit("region = 'NA'"))
    right = F.array(
        F.lit("(Region='NA')"), F.when(low, F.lit("status <> 'active'")).otherwise(F.lit("(((((STATUS   =  'active')))))"))
    )
    choice = F.array(F.lit("(a = 1) OR (b = 2)"))
    other = F.array(F.when(status == "P", F.lit("b = 2 or a = 3")).otherwise(F.lit("b = 2 or a = 1")))
    quoted = F.array(F.lit("city = 'New  York'"), F.lit("label = '(x)'"), F.lit("expr = 'a<b'"))
    changed = F.array(F.lit("label='(x)'"), F.lit("EXPR = 'a<b'"), F.when(low, F.lit("city='New  York'")).otherwise(F.lit("city = 'New York'")))
    nested = F.array(F.lit("(a = 1 or (b = 2 and x between 1 and 5)) and c = 3"))
    turned = F.array(F.concat(F.lit("C = 3 AND ((X BETWEEN 1 AND 5 AND b=2) OR A="), F.when(status == "F", "2").otherwise("1"), F.lit(")")))
    return t(spark, d, "orders").select(
        "o_orderkey",
        D.same_population(left, right).alias("same_population"),
        D.same_population(choice, other).alias("same_choice"),
        D.same_population(quoted, changed).alias("same_quoted"),
        D.same_population(nested, turned).alias("same_nested"),
    )


# --- clause drift ----------------------------------------------------------------------------------


def _baseline(spark, d):
    kinds = t(spark, d, "events").select(F.col("event_type").alias("metric_id")).distinct()
    no_filter = F.col("metric_id") == "click"
    return kinds.select(
        "metric_id",
        F.when(no_filter, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("region = 'NA'"), F.lit("status = 'active'")))
        .alias("where_conjuncts"),
        F.array(F.lit("SUM(amount)")).alias("agg_calls"),
        F.array(F.lit("date_trunc('month', ts)"), F.lit("t.Customer_Id")).alias("group_by"),
        F.array(F.lit("transactions")).alias("tables"),
        F.lit(1).cast("bigint").alias("n_joins"),
        F.lit(0).alias("n_open_joins"),
        F.lit(1).cast("bigint").alias("n_coalesce"),
        F.lit(None).cast("string").alias("having"),
    )


DRIFT = f"""
    {LOG},
    findings AS (
      SELECT request_id, metric_id, 'FILTER_REMOVAL' AS drift_type, 'FATAL' AS severity FROM query_log
      WHERE metric_id <> 'click' AND len(where_conjuncts) = 0
      UNION ALL SELECT request_id, metric_id, 'FILTER_ADDITION', 'HIGH' FROM query_log WHERE metric_id = 'click' AND len(where_conjuncts) > 0
      UNION ALL SELECT request_id, metric_id, 'SEMANTIC_LOGIC_SHIFT', 'CRITICAL' FROM query_log
      WHERE metric_id <> 'click' AND len(where_conjuncts) > 0 AND NOT (k % 3 <> 0 AND k % 4 <> 0 AND k % 11 <> 0)
      UNION ALL SELECT request_id, metric_id, 'AGGREGATION_FUNCTION_SHIFT', 'HIGH' FROM query_log WHERE k % 8 = 0 OR k % 9 = 0
      UNION ALL SELECT request_id, metric_id, 'JOIN_TYPE_SHIFT', 'HIGH' FROM query_log WHERE n_joins <> 1
      UNION ALL SELECT request_id, metric_id, 'JOIN_PREDICATE_MUTATION', 'FATAL' FROM query_log WHERE n_open_joins > 0
      UNION ALL SELECT request_id, metric_id, 'GRAIN_DRIFT', 'CRITICAL' FROM query_log WHERE k % 5 = 0 OR k % 7 = 0
      UNION ALL SELECT request_id, metric_id, 'NULL_HANDLING_DRIFT', 'MEDIUM' FROM query_log WHERE n_coalesce < 1
      UNION ALL SELECT request_id, metric_id, 'HAVING_FILTER_SHIFT', 'HIGH' FROM query_log WHERE k % 19 = 0
      UNION ALL SELECT request_id, metric_id, 'TABLE_TARGET_SHIFT', 'HIGH' FROM query_log WHERE k % 13 = 0)"""


def _findings(spark, d):
    return D.clause_drift(_baseline(spark, d), derived.query_log(spark, d), "metric_id", ["request_id"])


@demo("gv_drift", f"WITH {DRIFT} SELECT * FROM findings")
def gv_drift(spark, d):
    return _findings(spark, d).drop("original", "candidate")


@demo(
    "gv_max_severity",
    f"""
    WITH {DRIFT},
    ranked AS (SELECT request_id, count(*) AS findings,
                      max(CASE severity WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 5 END) AS r FROM findings GROUP BY 1)
    SELECT q.request_id, coalesce(findings, 0) AS findings, (['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL', 'FATAL'])[coalesce(r, 0) + 1] AS max_severity,
           CASE WHEN coalesce(r, 0) >= 4 THEN 'DENY' WHEN findings > 0 THEN 'REQUIRE_REVIEW' ELSE 'ALLOW' END AS decision
    FROM query_log q LEFT JOIN ranked USING (request_id)
    """,
)
def gv_max_severity(spark, d):
    return D.max_severity(_findings(spark, d), ["request_id"], derived.query_log(spark, d))


@demo(
    "snk_findings",
    f"""
    WITH {DRIFT}
    SELECT 'DRIFT-' || drift_type AS rule_id, CASE WHEN max(severity) = 'MEDIUM' THEN 'warning' ELSE 'error' END AS level, count(*) AS findings
    FROM findings GROUP BY drift_type
    """,
)
def snk_findings(spark, d):
    path = scratch_path(spark, "findings")
    sinks.write_findings(_findings(spark, d), path)
    rules = spark.read.json(f"{path}/rules")
    written = spark.read.json(f"{path}/findings").groupBy("drift_type").agg(F.count(F.lit(1)).alias("findings"), F.max("level").alias("level"))
    return written.select(F.concat(F.lit("DRIFT-"), "drift_type").alias("rule_id"), "level", "findings").join(rules.select("rule_id"), "rule_id", "left_semi")


# --- decisions -------------------------------------------------------------------------------------

DECIDED = f"""
    {V},
    per AS (SELECT request_id, count(*) AS n, bool_or(severity = 'CRITICAL') AS err FROM violations GROUP BY 1),
    decided AS (
      SELECT q.*, coalesce(n, 0) AS violations,
             CASE WHEN metric_id = 'error' THEN 'DENY' WHEN n IS NULL THEN 'ALLOW' WHEN err THEN 'DENY' ELSE 'AUDIT' END AS decision,
             CASE WHEN metric_id = 'error' THEN 'CRITICAL' WHEN n IS NULL THEN 'LOW' WHEN err THEN 'CRITICAL' ELSE 'HIGH' END AS risk
      FROM query_log q LEFT JOIN per USING (request_id))"""


@demo(
    "gv_decision",
    f"WITH {DECIDED} SELECT request_id, decision, risk, decision IN ('ALLOW', 'AUDIT') AS execution_allowed FROM decided",
)
def gv_decision(spark, d):
    return G.decide(_checked(spark, d)).select("request_id", "decision", "risk", "execution_allowed")


@demo(
    "jn_registry",
    f"""
    WITH {LOG} SELECT metric_id, metric_id <> 'error' AS known_metric, CASE WHEN metric_id = 'error' THEN 'DENY' ELSE 'CHECK' END AS decision, count(*) AS requests
    FROM query_log GROUP BY ALL
    """,
)
def jn_registry(spark, d):
    checked = _checked(spark, d)
    unknown = F.when(F.col("known_metric"), "CHECK").otherwise("DENY")
    return checked.groupBy("metric_id", "known_metric", unknown.alias("decision")).agg(F.count(F.lit(1)).alias("requests"))


@demo(
    "gv_stats",
    f"""
    WITH {DECIDED}
    SELECT agent_id, count(*) AS requests, count(*) FILTER (WHERE decision = 'ALLOW') AS allowed, count(*) FILTER (WHERE decision = 'AUDIT') AS audited,
           count(*) FILTER (WHERE decision = 'REQUIRE_REVIEW') AS reviews, count(*) FILTER (WHERE decision = 'DENY') AS denied,
           count(*) FILTER (WHERE decision NOT IN ('ALLOW', 'AUDIT')) AS blocked, sum(violations)::BIGINT AS violations,
           round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms,
           round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms
    FROM decided GROUP BY 1
    """,
)
def gv_stats(spark, d):
    stats = G.request_stats(G.decide(_checked(spark, d)))
    return stats.withColumns({c: F.round(c, 6) for c in ("p50_ms", "p95_ms", "p99_ms")})


@demo("gv_stats_rules", f"WITH {V} SELECT rule, count(*) AS violations FROM violations GROUP BY 1")
def gv_stats_rules(spark, d):
    return G.violation_counts(_checked(spark, d))


@demo(
    "gv_oracle_map",
    f"""
    WITH {V}
    SELECT rule, CASE WHEN category = 'population' THEN 'FILTER_DROP' WHEN category = 'grain' THEN 'GRAIN_DROP'
                      WHEN rule LIKE '%negative%' THEN 'MATH_OPERATOR_INVERT' WHEN category = 'aggregation' THEN 'AGGREGATION_SWAP'
                      ELSE 'UNKNOWN' END AS fault_family, count(*) AS violations
    FROM violations GROUP BY ALL
    """,
)
def gv_oracle_map(spark, d):
    return G.violation_rows(_checked(spark, d)).groupBy("rule", "fault_family").agg(F.count(F.lit(1)).alias("violations"))


@demo(
    "gv_limits",
    """
    SELECT doc_id, CASE WHEN length(text) > 50000 THEN 'payload_limit' WHEN n_chars % 997 > 500 THEN 'complexity_limit'
                        WHEN n_chars > 100000 THEN 'payload_size' END AS limit_breach,
           CASE WHEN length(text) > 50000 OR n_chars % 997 > 500 OR n_chars > 100000 THEN 'DENY' ELSE 'ALLOW' END AS decision
    FROM documents
    """,
)
def gv_limits(spark, d):
    docs = t(spark, d, "documents")
    return G.check_limits(docs, F.col("text"), F.col("n_chars") % 997, F.col("n_chars")).select("doc_id", "limit_breach", "decision")


@demo(
    "gv_risk",
    """
    WITH e AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events)
    SELECT event_id,
           CASE WHEN k % 20 = 0 THEN 'REJECTED_SYNTAX_ERROR' WHEN k % 9 = 0 THEN 'REJECTED_EXECUTION_FAILURE'
                WHEN k % 3 > 0 AND k % 4 = 0 THEN 'SILENT_SEMANTIC_BREACH_SURVIVED_TESTS'
                WHEN k % 3 > 0 OR k % 4 > 0 THEN 'REJECTED_SEMANTIC_DEFECT_DETECTED' ELSE 'ACCEPTED_SEMANTICALLY_COMPLIANT' END AS verdict,
           CASE WHEN k % 20 = 0 OR k % 9 = 0 THEN 'CRITICAL' WHEN k % 3 > 0 OR k % 4 > 0 THEN 'HIGH' ELSE 'LOW' END AS semantic_risk
    FROM e
    """,
)
def gv_risk(spark, d):
    k = F.col("k")
    evaluated = derived.keyed_events(spark, d).select(
        "event_id",
        (k % 20 != 0).alias("syntax_ok"),
        (k % 9 != 0).alias("execution_success"),
        (k % 3).alias("n_violations"),
        (k % 4).alias("n_failed_assertions"),
    )
    return G.risk_verdict(evaluated).select("event_id", "verdict", "semantic_risk")


@demo(
    "gv_route",
    f"""
    WITH {DECIDED},
    routed AS (SELECT *, metric_id <> 'error' AND violations = 0 AS ok,
                      CASE WHEN n_cte > 1 THEN 'Complex query graph: ' || n_cte || ' CTEs detected'
                           WHEN n_subquery > 1 THEN 'Nested subqueries: ' || n_subquery || ' subqueries detected'
                           WHEN n_window > 0 THEN 'Window function detected (qualify/partition logic requires relational execution)'
                           WHEN n_case > 1 THEN 'Multiple conditional branches (CASE WHEN) require runtime contrastive evaluation' END AS why FROM decided)
    SELECT request_id, CASE WHEN ok THEN why END AS escalation_reason,
           CASE WHEN ok AND why IS NOT NULL THEN 'tier_4_escalated' ELSE 'tier_3_static' END AS routing_tier,
           CASE WHEN NOT ok THEN 'tier_3_static_rejected' WHEN why IS NULL THEN 'tier_3_static_approved'
                WHEN k % 2 = 1 THEN 'tier_4_escalated_approved' ELSE 'tier_4_escalated_rejected' END AS routing_decision
    FROM routed
    """,
)
def gv_route(spark, d):
    routed = G.route(_checked(spark, d), runtime_passed=F.col("k") % 2 == 1)
    return routed.select("request_id", "escalation_reason", "routing_tier", "routing_decision")


@demo(
    "gv_cost",
    """
    WITH b AS (SELECT event_id, floor(value * 10000000000)::BIGINT AS bytes_processed FROM events),
         c AS (SELECT *, bytes_processed::DOUBLE / 1099511627776.0::DOUBLE AS tib FROM b)
    SELECT event_id, round(tib, 6) AS tib_processed, round(tib * 6.25::DOUBLE, 4) AS gross_cost_usd,
           round(greatest(0.0::DOUBLE, tib - 1.0) * 6.25::DOUBLE, 4) AS billable_cost_usd,
           CASE WHEN bytes_processed > 1000000000000 THEN 'DENY' ELSE 'ALLOW' END AS cost_decision
    FROM c
    """,
)
def gv_cost(spark, d):
    log = t(spark, d, "events").select(
        "event_id", F.floor(F.col("value") * 10_000_000_000).alias("bytes_processed")
    )
    pricing = G.Pricing(maximum_bytes_billed=1_000_000_000_000)
    return G.estimate_cost(log, pricing, apply_free_tier=True).drop("bytes_processed")


# --- manifests and releases ------------------------------------------------------------------------


def _manifests(spark, d):
    """One manifest document per supplier: its nation's model and a few nodes of its own."""
    key = F.col("s_suppkey")

    def node(suffix, kind, compiled, raw):
        value = F.struct(
            F.concat(F.lit(suffix), key).alias("name"), F.lit(kind).alias("resource_type"), compiled.alias("compiled_code"), raw.alias("raw_code")
        )
        return F.concat(F.lit(f"{kind}.{suffix}"), key), value

    nodes = [
        node("a_", "model", F.when(key % 2 == 0, F.lit("SELECT 1")), F.lit("select 1")),
        node("b_", "model", F.lit("  "), F.when(key % 3 != 0, F.lit("select 2"))),
        node("c_", "seed", F.lit(None).cast("string"), F.lit("x")),
    ]
    entries = F.map_from_entries(F.array(*[F.struct(k.alias("key"), v.alias("value")) for k, v in nodes]))
    return t(spark, d, "supplier").select(F.to_json(F.struct(entries.alias("nodes"))).alias("content"))


@demo(
    "src_manifest",
    """
    SELECT 'model.a_' || s_suppkey AS node_id, 'a_' || s_suppkey AS name, 'model' AS resource_type FROM supplier
    UNION ALL SELECT 'model.b_' || s_suppkey, 'b_' || s_suppkey, 'model' FROM supplier
    UNION ALL SELECT 'seed.c_' || s_suppkey, 'c_' || s_suppkey, 'seed' FROM supplier
    """,
)
def src_manifest(spark, d):
    path = scratch_path(spark, "manifest")
    _manifests(spark, d).write.option("lineSep", "\n").text(path)
    return documents.read_manifest(spark, path, whole=False).select("node_id", "name", "resource_type")


@demo(
    "gv_manifest",
    """
    SELECT 'model.a_' || s_suppkey AS node_id, CASE WHEN s_suppkey % 2 = 0 THEN 'COMPILED_SQL_PRESENT' ELSE 'RAW_CODE_ONLY' END AS resolution_status,
           CASE WHEN s_suppkey % 2 = 0 THEN 'SELECT 1' ELSE 'select 1' END AS sql FROM supplier
    UNION ALL SELECT 'model.b_' || s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN 'RAW_CODE_ONLY' ELSE 'COMPILED_SQL_ABSENT' END,
           CASE WHEN s_suppkey % 3 <> 0 THEN 'select 2' END FROM supplier
    UNION ALL SELECT 'seed.c_' || s_suppkey, 'UNSUPPORTED_RESOURCE_TYPE', NULL FROM supplier
    """,
)
def gv_manifest(spark, d):
    nodes = documents.manifest_nodes(_manifests(spark, d))
    return G.manifest_status(nodes, require_compiled=False).select("node_id", "resolution_status", "sql")


@demo(
    "gv_integrity",
    """
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'UNVERSIONED' WHEN doc_id % 3 = 0 THEN 'MODIFIED' WHEN doc_id % 7 = 0 THEN 'MODIFIED' ELSE 'VERIFIED' END AS integrity
    FROM documents
    """,
)
def gv_integrity(spark, d):
    doc, commit = F.col("doc_id"), F.sha2(F.col("text"), 256)
    other = F.sha2(F.concat(F.lit("other"), "text"), 256)
    releases = t(spark, d, "documents").select(
        "doc_id",
        F.when(doc % 7 == 0, F.lit("")).when(doc % 3 == 0, other).otherwise(F.substring(commit, 1, 7)).alias("declared_commit"),
        F.when(doc % 5 != 0, commit).alias("current_commit"),
    )
    return G.integrity_status(releases).select("doc_id", "integrity")


# --- readers over files that Spark writes from the tables ------------------------------------------


@demo("src_csv", "SELECT event_id, user_id, event_type, value FROM events")
def src_csv(spark, d):
    path = scratch_path(spark, "csv")
    t(spark, d, "events").select("event_id", "user_id", "event_type", "value").write.option("header", True).csv(path)
    return read_csv(spark, path, "event_id bigint, user_id bigint, event_type string, value double")


@demo(
    "src_contracts",
    """
    SELECT 'metric_' || p_partkey AS metric_id, 'status = ''' || lower(p_type) || '''' AS required_filters, (p_size % 3)::BIGINT AS n_dimensions,
           CASE WHEN p_size % 2 = 0 THEN 'SUM' END AS required_function
    FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 10 <> 0
    """,
)
def src_contracts(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    filters = F.concat(F.lit("  population:\n    required_filters:\n      - status = '"), F.lower("p_type"), F.lit("'\n"))
    dims = F.array_join(F.transform(F.sequence(F.lit(1), (size % 3 + 1).cast("int")), lambda i: F.concat(F.lit("d"), i)), ", ")
    listed = F.when(size % 3 == 0, F.lit("[]")).otherwise(F.concat(F.lit("["), F.regexp_replace(dims, ", d[0-9]+$", ""), F.lit("]")))
    good = F.concat(
        F.when(key % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("metric: metric_"), key, F.lit("\n"))),
        F.lit("owner: data\ninvariants:\n"),
        filters,
        F.lit("  grain:\n    required_dimensions: "),
        listed,
        F.lit("\n"),
        F.when(size % 2 == 0, F.lit("  aggregation:\n    required_function: SUM\n")).otherwise(""),
    )
    written = t(spark, d, "part").select(
        F.concat(F.lit("contracts/"), key, F.lit(".yaml")).alias("path"),
        F.when(key % 9 == 0, F.lit("metric: [unclosed")).otherwise(good).alias("content"),
    )
    path = scratch_path(spark, "contracts")
    written.select("content").write.option("lineSep", "\n---\n").text(path)
    accepted, _ = documents.read_contracts(spark, path, separator="\n---\n")
    rules = documents.contract_rules(accepted)
    return rules.select(
        "metric_id",
        F.array_join("required_filters", ";").alias("required_filters"),
        F.size("required_dimensions").cast("bigint").alias("n_dimensions"),
        "required_function",
    )


@demo(
    "src_traces",
    f"WITH {LOG} SELECT request_id::VARCHAR AS trace_id, agent_id, metric_id, sha256(trim(sql)) AS sql_hash FROM query_log WHERE k % 21 <> 0",
)
def src_traces(spark, d):
    path = scratch_path(spark, "traces")
    log = derived.query_log(spark, d)
    record = F.to_json(
        F.struct(
            F.col("request_id").cast("string").alias("trace_id"), "agent_id", "metric_id", "sql", text.text_hash(F.col("sql")).alias("sql_hash")
        )
    )
    log.select(F.when(F.col("k") % 21 == 0, F.lit('{"trace_id": ')).otherwise(record).alias("value")).write.text(path)
    good, _ = documents.read_traces(spark, path)
    return good.select("trace_id", "agent_id", "metric_id", "sql_hash")


@demo(
    "src_trajectories",
    f"WITH {derived.TRAJECTORIES} SELECT scenario_id, agent_type, n_calls, latency_ms FROM trajectories",
)
def src_trajectories(spark, d):
    path = scratch_path(spark, "trajectories")
    calls = F.transform("tool_calls", lambda c: F.struct(c.alias("tool")))
    derived.trajectories(spark, d).withColumn("tool_calls", calls).write.json(path)
    good, _ = documents.read_trajectories(spark, path)
    return good.select("scenario_id", "agent_type", F.size("tool_calls").cast("bigint").alias("n_calls"), "latency_ms")
