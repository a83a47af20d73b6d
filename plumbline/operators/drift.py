"""Clause drift: what changed between the agreed query and the one that runs?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators.governance import SEVERITIES

# The severity of each kind of drift, and its level in finding reports.
DRIFT_SEVERITY = {
    "FILTER_REMOVAL": "FATAL",
    "FILTER_ADDITION": "HIGH",
    "SEMANTIC_LOGIC_SHIFT": "CRITICAL",
    "AGGREGATION_FUNCTION_SHIFT": "HIGH",
    "AGGREGATION_EXPRESSION_SHIFT": "HIGH",
    "JOIN_TYPE_SHIFT": "HIGH",
    "JOIN_PREDICATE_MUTATION": "FATAL",
    "GRAIN_DRIFT": "CRITICAL",
    "NULL_HANDLING_DRIFT": "MEDIUM",
    "HAVING_FILTER_SHIFT": "HIGH",
    "TABLE_TARGET_SHIFT": "HIGH",
}
FINDING_LEVEL = {
    "FATAL": "error",
    "CRITICAL": "error",
    "HIGH": "error",
    "MEDIUM": "warning",
    "LOW": "note",
    "INFO": "none",
}


def same_population(left: Column, right: Column) -> Column:
    """AND lists are equal whatever their order, case, blanks and parentheses."""
    return text.canonical_conjuncts(left) == text.canonical_conjuncts(right)


def _strings(column: Column) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def _function_names(calls: Column) -> Column:
    return F.array_sort(F.transform(calls, lambda c: F.upper(F.trim(F.substring_index(c, "(", 1)))))


def _joined(values: Column) -> Column:
    return F.when(F.size(values) == 0, F.lit("[NONE]")).otherwise(F.array_join(values, ", "))


def _finding(kind: str, changed: Column, old: Column, new: Column) -> Column:
    return F.when(
        changed,
        F.struct(
            F.lit(kind).alias("drift_type"),
            F.lit(DRIFT_SEVERITY[kind]).alias("severity"),
            old.cast("string").alias("original"),
            new.cast("string").alias("candidate"),
        ),
    )


def _clauses() -> Column:
    """The clauses of one query in comparable form, computed before the sides meet."""
    where, aggs = _strings(F.col("where_conjuncts")), _strings(F.col("agg_calls"))
    return F.struct(
        where.alias("where"),
        text.canonical_conjuncts(where).alias("canonical_where"),
        _function_names(aggs).alias("functions"),
        F.array_sort(aggs).alias("aggs"),
        F.array_sort(_strings(F.col("group_by"))).alias("grain"),
        F.array_sort(F.array_distinct(_strings(F.col("tables")))).alias("tables"),
        "n_joins",
        "n_open_joins",
        "n_coalesce",
        "having",
    )


def clause_drift(baseline: DataFrame, candidate: DataFrame, on: str = "metric_id", keep: Sequence[str] = ()) -> DataFrame:
    """One row per finding: the key, ``keep`` columns of the candidate, type, severity, snippets.

    ``baseline`` holds one row per key.  Columns on both sides: where_conjuncts,
    agg_calls, group_by, tables (arrays), n_joins, n_open_joins, n_coalesce, having.
    """
    rows = candidate.select(on, *keep, _clauses().alias("c")).join(baseline.select(on, _clauses().alias("b")), on)

    def differ(name):
        return F.col(f"b.{name}") != F.col(f"c.{name}")

    def lists(kind, changed, name):
        return _finding(kind, changed, _joined(F.col(f"b.{name}")), _joined(F.col(f"c.{name}")))

    def values(kind, changed, name):
        return _finding(kind, changed, F.col(f"b.{name}"), F.col(f"c.{name}"))

    had, has = F.size("b.where") > 0, F.size("c.where") > 0
    findings = [
        lists("FILTER_REMOVAL", had & ~has, "where"),
        lists("FILTER_ADDITION", ~had & has, "where"),
        lists("SEMANTIC_LOGIC_SHIFT", had & has & differ("canonical_where"), "where"),
        lists("AGGREGATION_FUNCTION_SHIFT", differ("functions"), "aggs"),
        lists("AGGREGATION_EXPRESSION_SHIFT", ~differ("functions") & differ("aggs"), "aggs"),
        values("JOIN_TYPE_SHIFT", differ("n_joins"), "n_joins"),
        values("JOIN_PREDICATE_MUTATION", F.col("c.n_open_joins") > 0, "n_open_joins"),
        lists("GRAIN_DRIFT", differ("grain"), "grain"),
        values("NULL_HANDLING_DRIFT", F.col("b.n_coalesce") > F.col("c.n_coalesce"), "n_coalesce"),
        values("HAVING_FILTER_SHIFT", ~F.col("b.having").eqNullSafe(F.col("c.having")), "having"),
        lists("TABLE_TARGET_SHIFT", differ("tables"), "tables"),
    ]
    return rows.select(on, *keep, F.inline(F.array_compact(F.array(*findings))))


def severity_rank(severity: Column) -> Column:
    rank = F.lit(0)
    for i, name in enumerate(SEVERITIES):
        rank = F.when(severity == name, F.lit(i)).otherwise(rank)
    return rank


def max_severity(findings: DataFrame, by: Sequence[str], everyone: DataFrame | None = None) -> DataFrame:
    """Worst severity and decision per key.

    With ``everyone`` (the keys that were checked) a key without a finding is
    reported as INFO and ALLOW.
    """
    worst = findings.groupBy(*by).agg(
        F.max(severity_rank(F.col("severity"))).alias("rank"), F.count(F.lit(1)).alias("findings")
    )
    if everyone is not None:
        worst = everyone.select(*by).distinct().join(worst, list(by), "left").na.fill({"rank": 0, "findings": 0})
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    return worst.select(
        *by,
        "findings",
        F.get(names, F.col("rank")).alias("max_severity"),
        F.when(F.col("rank") >= SEVERITIES.index("CRITICAL"), "DENY")
        .when(F.col("findings") > 0, "REQUIRE_REVIEW")
        .otherwise("ALLOW")
        .alias("decision"),
    )


def finding_level(severity: Column) -> Column:
    level = F.lit("warning")
    for name, value in FINDING_LEVEL.items():
        level = F.when(severity == name, F.lit(value)).otherwise(level)
    return level


def rule_catalogue(findings: DataFrame, prefix: str = "DRIFT-") -> DataFrame:
    """One row per rule that occurs, with its level and number of findings."""
    return findings.groupBy(F.concat(F.lit(prefix), F.col("drift_type")).alias("rule_id")).agg(
        F.max(finding_level(F.col("severity"))).alias("level"), F.count(F.lit(1)).alias("findings")
    )
