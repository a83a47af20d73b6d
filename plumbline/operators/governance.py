"""Jobs over query logs: contract compliance, decisions, routing, limits and cost.

A log row brings its clauses as arrays (from the catalog or a lineage export), so
no query text is parsed here.  All rules of one request are array expressions on
that row: the only data movement is the lookup of its contract.

Expected log columns: request_id, metric_id, agent_id, sql, where_conjuncts,
group_by, agg_calls, tables, n_joins, n_open_joins, having, n_coalesce, n_cte,
n_subquery, n_window, n_case, bytes_processed, latency_ms, ts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators.percentiles import aggregate_with_percentiles

# Severities in rising order, and those that count as errors.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL", "FATAL")
ERROR_LEVELS = ("ERROR", "CRITICAL", "FATAL")

# Size limits of a request.
MAX_SQL_CHARS = 50_000
MAX_PAYLOAD_CHARS = 100_000
MAX_NODES = 500

VIOLATION = "struct<rule:string,category:string,severity:string,expected:string>"


def _violation(rule: str, category: str, severity: str, expected: Column) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(category).alias("category"),
        F.lit(severity).alias("severity"),
        expected.cast("string").alias("expected"),
    )


def _none() -> Column:
    return F.array().cast(f"array<{VIOLATION}>")


def _strings(column: Column) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def _each(expected: Column, broken, rule: str, category: str, severity: str) -> Column:
    """One violation per entry of ``expected`` on which ``broken`` holds."""
    return F.transform(F.filter(_strings(expected), broken), lambda e: _violation(rule, category, severity, e))


def with_canonical_clauses(query_log: DataFrame) -> DataFrame:
    """Adds the canonical clauses the rules look at: ``__held``, ``__grouped``, ``__sql``.

    They are columns of their own, so each is computed once per row and not once
    per rule or per entry of a rule.
    """
    have = set(query_log.columns)
    added = {}
    if "where_conjuncts" in have:
        added["__held"] = text.normalise_predicates(_strings(F.col("where_conjuncts")))
    if "group_by" in have:
        added["__grouped"] = F.transform(_strings(F.col("group_by")), text.normalise_dimension)
    if "sql" in have:
        added["__sql"] = F.lower(F.coalesce("sql", F.lit("")))
    return query_log.withColumns(added)


def with_canonical_rules(contracts: DataFrame) -> DataFrame:
    """Contract rules with the canonical form of each entry next to its text."""
    def paired(column, canonical):
        return F.arrays_zip(_strings(F.col(column)).alias("raw"), canonical(_strings(F.col(column))).alias("norm"))

    dims = lambda a: F.transform(a, text.normalise_dimension)
    return contracts.select(
        "metric_id",
        F.struct(
            F.col("required_filters"),
            paired("required_filters", text.normalise_predicates).alias("required"),
            paired("forbidden_filters", text.normalise_predicates).alias("forbidden"),
            paired("required_dimensions", dims).alias("dimensions"),
            "required_function",
            "positive_components",
            "negative_components",
            "timezone",
        ).alias("rules"),
    )


def _paired_violations(pairs: Column, broken, rule: str, category: str) -> Column:
    hits = F.filter(pairs, lambda p: broken(p["norm"]))
    return F.transform(hits, lambda p: _violation(rule, category, "CRITICAL", p["raw"]))


def required_filter_violations(pairs: Column) -> Column:
    """Required predicates that are no conjunct of the query."""
    return _paired_violations(
        pairs, lambda e: ~F.array_contains(F.col("__held"), e), "required_filters", "population"
    )


def required_text_violations(required: Column) -> Column:
    """The laxer form: the predicate occurs somewhere in the joined filter text."""
    joined = F.concat_ws(" AND ", F.col("where_conjuncts"))
    return _each(required, lambda e: ~F.contains(joined, e), "required_filters", "population", "CRITICAL")


def forbidden_filter_violations(pairs: Column) -> Column:
    return _paired_violations(
        pairs, lambda e: F.array_contains(F.col("__held"), e), "forbidden_filters", "population"
    )


def grain_violations(pairs: Column) -> Column:
    """Required dimensions that no grouping expression covers; containment either way counts."""
    def absent(e):
        return ~F.exists("__grouped", lambda d: F.contains(d, e) | F.contains(e, d))

    return _paired_violations(pairs, absent, "required_dimensions", "grain")


def component_violations(components: Column, rule: str) -> Column:
    return _each(components, lambda e: ~F.contains(F.col("__sql"), F.lower(e)), rule, "aggregation", "HIGH")


def function_violations(function: Column) -> Column:
    """The required aggregate function is called somewhere."""
    called = F.exists(
        _strings(F.col("agg_calls")), lambda c: F.startswith(F.upper(F.trim(c)), F.concat(F.upper(function), F.lit("(")))
    )
    return F.when(
        function.isNotNull() & ~called, F.array(_violation("required_function", "aggregation", "HIGH", function))
    ).otherwise(_none())


def timezone_violations(timezone: Column) -> Column:
    """A UTC contract: text that converts time zones has to name UTC."""
    sql = F.col("__sql")
    broken = (F.upper(timezone) == "UTC") & F.contains(sql, F.lit("time zone")) & ~F.contains(sql, F.lit("utc"))
    return F.when(broken, F.array(_violation("timezone", "time", "HIGH", timezone))).otherwise(_none())


def check_compliance(query_log: DataFrame, contracts: DataFrame, mode: str = "equality") -> DataFrame:
    """Log rows with ``known_metric``, ``violations``, ``passed`` and ``rules_checked``.

    Contract columns: metric_id, required_filters, forbidden_filters,
    required_dimensions, required_function, positive_components,
    negative_components, timezone; one row per metric.  ``mode="contains"``
    looks for required predicates in the filter text instead of its conjuncts.
    """
    joined = with_canonical_clauses(query_log).join(with_canonical_rules(contracts), "metric_id", "left")
    known = F.col("rules").isNotNull()
    required = (
        required_text_violations(F.col("rules.required_filters"))
        if mode == "contains"
        else required_filter_violations(F.col("rules.required"))
    )
    found = F.concat(
        required,
        forbidden_filter_violations(F.col("rules.forbidden")),
        grain_violations(F.col("rules.dimensions")),
        function_violations(F.col("rules.required_function")),
        component_violations(F.col("rules.positive_components"), "positive_components"),
        component_violations(F.col("rules.negative_components"), "negative_components"),
        timezone_violations(F.col("rules.timezone")),
    )
    # population and aggregation always count, grain and time zone where declared
    checked = (
        F.lit(2) + (F.size("rules.dimensions") > 0).cast("int") + F.col("rules.timezone").isNotNull().cast("int")
    )
    return (
        joined.withColumn("known_metric", known)
        .withColumn("violations", F.when(known, found).otherwise(_none()))
        .withColumn("passed", known & (F.size("violations") == 0))
        .withColumn("rules_checked", F.when(known, checked).otherwise(F.lit(0)))
        .drop("rules", "__held", "__grouped", "__sql")
    )


def decide(checked: DataFrame, strict: bool = True, breach_is_error: bool = False) -> DataFrame:
    """Adds decision, risk and execution_allowed to the output of :func:`check_compliance`.

    ``breach_is_error`` treats every contract violation as an error, as a gateway
    in front of a warehouse does; otherwise the severities of the rules decide.
    """
    clean = F.size("violations") == 0
    error = F.lit(breach_is_error) | F.exists("violations", lambda v: F.upper(v["severity"]).isin(*ERROR_LEVELS))
    decision = (
        F.when(~F.col("known_metric"), "DENY")
        .when(clean, "ALLOW")
        .when(error, "DENY" if strict else "REQUIRE_REVIEW")
        .otherwise("AUDIT")
    )
    risk = (
        F.when(~F.col("known_metric"), "CRITICAL").when(clean, "LOW").when(error, "CRITICAL").otherwise("HIGH")
    )
    return checked.withColumns({"decision": decision, "risk": risk}).withColumn(
        "execution_allowed", F.col("decision").isin("ALLOW", "AUDIT")
    )


def fault_family(rule: Column, category: Column) -> Column:
    """The fault a violation is the mirror image of; the first matching word decides."""
    words = F.lower(F.concat_ws(" ", rule, category))

    def mentions(*terms):
        flags = [F.contains(words, F.lit(t)) for t in terms]
        hit = flags[0]
        for flag in flags[1:]:
            hit = hit | flag
        return hit

    return (
        F.when(mentions("population", "filter"), "FILTER_DROP")
        .when(mentions("grain", "group", "dimension"), "GRAIN_DROP")
        .when(mentions("negative", "deduction", "subtraction"), "MATH_OPERATOR_INVERT")
        .when(mentions("aggregation", "function", "component"), "AGGREGATION_SWAP")
        .when(mentions("coalesce", "null"), "NULL_COALESCE_DROP")
        .otherwise("UNKNOWN")
    )


def violation_rows(checked: DataFrame, keep: Sequence[str] = ("request_id",)) -> DataFrame:
    """One row per violation, with its fault family."""
    rows = checked.select(*keep, F.inline("violations"))
    return rows.withColumn("fault_family", fault_family(F.col("rule"), F.col("category")))


def request_stats(decided: DataFrame, by: Sequence[str] = ("agent_id",)) -> DataFrame:
    """Requests, decisions, blocked share and latency percentiles per group."""
    def decisions(label):
        return F.count_if(F.col("decision") == label)

    aggregates = [
        F.count(F.lit(1)).alias("requests"),
        decisions("ALLOW").alias("allowed"),
        decisions("AUDIT").alias("audited"),
        decisions("REQUIRE_REVIEW").alias("reviews"),
        decisions("DENY").alias("denied"),
        F.count_if(~F.col("execution_allowed")).alias("blocked"),
        F.coalesce(F.sum(F.size("violations")), F.lit(0)).cast("bigint").alias("violations"),
    ]
    probabilities = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    return aggregate_with_percentiles(decided, aggregates, "latency_ms", probabilities, by)


def violation_counts(checked: DataFrame) -> DataFrame:
    return violation_rows(checked, ()).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


def check_limits(requests: DataFrame, sql: Column, nodes: Column | None = None, payload: Column | None = None) -> DataFrame:
    """Adds ``limit_breach`` (NULL if none) and ``decision`` from the size limits."""
    breach = F.when(F.length(sql) > MAX_SQL_CHARS, "payload_limit")
    if nodes is not None:
        breach = breach.when(nodes > MAX_NODES, "complexity_limit")
    if payload is not None:
        breach = breach.when(payload > MAX_PAYLOAD_CHARS, "payload_size")
    return requests.withColumn("limit_breach", breach).withColumn(
        "decision", F.when(F.col("limit_breach").isNotNull(), "DENY").otherwise("ALLOW")
    )


def risk_verdict(evaluated: DataFrame) -> DataFrame:
    """Adds verdict and semantic_risk.

    Input: syntax_ok, execution_success, n_violations, n_failed_assertions.
    """
    violated, failed = F.col("n_violations") > 0, F.col("n_failed_assertions") > 0
    verdict = (
        F.when(~F.col("syntax_ok"), "REJECTED_SYNTAX_ERROR")
        .when(~F.col("execution_success"), "REJECTED_EXECUTION_FAILURE")
        .when(violated & ~failed, "SILENT_SEMANTIC_BREACH_SURVIVED_TESTS")
        .when(violated | failed, "REJECTED_SEMANTIC_DEFECT_DETECTED")
        .otherwise("ACCEPTED_SEMANTICALLY_COMPLIANT")
    )
    risk = (
        F.when(~F.col("syntax_ok") | ~F.col("execution_success"), "CRITICAL")
        .when(violated | failed, "HIGH")
        .otherwise("LOW")
    )
    return evaluated.withColumns({"verdict": verdict, "semantic_risk": risk})


def escalation_reason() -> Column:
    """Why a query needs the data job besides the static rules; NULL if it does not."""
    return (
        F.when(F.col("n_cte") > 1, F.concat(F.lit("Complex query graph: "), F.col("n_cte"), F.lit(" CTEs detected")))
        .when(
            F.col("n_subquery") > 1,
            F.concat(F.lit("Nested subqueries: "), F.col("n_subquery"), F.lit(" subqueries detected")),
        )
        .when(
            F.col("n_window") > 0,
            F.lit("Window function detected (qualify/partition logic requires relational execution)"),
        )
        .when(
            F.col("n_case") > 1,
            F.lit("Multiple conditional branches (CASE WHEN) require runtime contrastive evaluation"),
        )
    )


def route(checked: DataFrame, runtime_passed: Column | None = None, force: bool = False) -> DataFrame:
    """Adds routing_tier, routing_decision and escalation_reason.

    Rejected requests never escalate.  ``runtime_passed`` is the verdict of the
    data job; without it escalated rows stay pending.
    """
    trigger = F.lit("Forced escalation requested by caller") if force else escalation_reason()
    reason = F.when(F.col("passed"), trigger)
    escalated = reason.isNotNull()
    outcome = F.lit("tier_4_escalated_pending")
    if runtime_passed is not None:
        outcome = F.when(runtime_passed, "tier_4_escalated_approved").otherwise("tier_4_escalated_rejected")
    return checked.withColumns(
        {
            "escalation_reason": reason,
            "routing_tier": F.when(escalated, "tier_4_escalated").otherwise("tier_3_static"),
            "routing_decision": F.when(~F.col("passed"), "tier_3_static_rejected")
            .when(escalated, outcome)
            .otherwise("tier_3_static_approved"),
        }
    )


@dataclass(frozen=True)
class Pricing:
    price_per_tib_usd: float = 6.25
    monthly_free_tib: float = 1.0
    maximum_bytes_billed: int | None = None


def estimate_cost(log: DataFrame, pricing: Pricing = Pricing(), apply_free_tier: bool = False, by: str = "bytes_processed") -> DataFrame:
    """Adds tib_processed, gross and billable cost, and ``cost_decision`` by the byte budget."""
    scanned = F.col(by)
    tib = scanned.cast("double") / F.lit(1024.0**4)
    billable = F.greatest(F.lit(0.0), tib - pricing.monthly_free_tib) if apply_free_tier else tib
    over = F.lit(False) if pricing.maximum_bytes_billed is None else scanned > pricing.maximum_bytes_billed
    return log.withColumns(
        {
            "tib_processed": F.round(tib, 6),
            "gross_cost_usd": F.round(tib * pricing.price_per_tib_usd, 4),
            "billable_cost_usd": F.round(billable * pricing.price_per_tib_usd, 4),
            "cost_decision": F.when(over, "DENY").otherwise("ALLOW"),
        }
    )


def manifest_status(nodes: DataFrame, require_compiled: bool = True) -> DataFrame:
    """Adds resolution_status and the SQL to check, from compiled_code and raw_code."""
    compiled = F.nullif(F.trim("compiled_code"), F.lit(""))
    raw = F.nullif(F.trim("raw_code"), F.lit(""))
    status = (
        F.when(F.col("resource_type").isNull(), "NODE_NOT_FOUND")
        .when(F.col("resource_type") != "model", "UNSUPPORTED_RESOURCE_TYPE")
        .when(compiled.isNotNull(), "COMPILED_SQL_PRESENT")
        .when(raw.isNotNull() & F.lit(not require_compiled), "RAW_CODE_ONLY")
        .otherwise("COMPILED_SQL_ABSENT")
    )
    return nodes.withColumn("resolution_status", status).withColumn(
        "sql",
        F.when(F.col("resolution_status") == "COMPILED_SQL_PRESENT", compiled).when(
            F.col("resolution_status") == "RAW_CODE_ONLY", raw
        ),
    )


def integrity_status(releases: DataFrame, declared: str = "declared_commit", current: str = "current_commit") -> DataFrame:
    """Adds integrity: commits agree if one starts with the first seven letters of the other."""
    have, want = F.col(current), F.col(declared)
    agree = F.startswith(have, F.substring(want, 1, 7)) | F.startswith(want, F.substring(have, 1, 7))
    return releases.withColumn(
        "integrity",
        F.when(have.isNull() | (have == ""), "UNVERSIONED")
        .when((F.coalesce(want, F.lit("")) != "") & agree, "VERIFIED")
        .otherwise("MODIFIED"),
    )
