"""The contract table: validation, listing, resolution and coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text

# Fixed values.
DIALECTS = ("snowflake", "bigquery", "postgres", "duckdb", "redshift", "databricks")
REQUIRED_FIELDS = ("metric", "owner", "grain", "sql")
COMPREHENSIVE_PCT = 75.0

# What a complete contract of each metric has to declare.
DOMAIN_REQUIREMENTS = {
    "net_revenue": ("population", "grain", "aggregation", "currency", "time"),
    "monthly_active_users": ("population", "grain", "time", "deduplication"),
    "customer_churn_rate": ("population", "grain", "churn_definition", "denominator_eligibility"),
    "average_order_value": ("population", "grain", "numerator_amount", "denominator_order_count"),
    "inventory_turnover": ("population", "grain", "cogs_component", "average_inventory"),
    "sla_compliance_rate": ("population", "grain", "clock_start", "clock_stop", "exclusion_filter"),
    "checkout_conversion_rate": ("population", "grain", "funnel_start_event", "funnel_complete_event"),
    "customer_retention_rate": ("population", "grain", "cohort_period", "returning_window", "eligibility"),
}
GENERIC_REQUIREMENT = ("population", "grain", "aggregation")


def _reject(bad: Column, reason: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(reason))


def validate_contracts(contracts: DataFrame) -> DataFrame:
    """Adds ``reasons`` (what is wrong) and ``accepted``.

    Optional fields are only tested where the table has the column and the row a
    value: urn, version, dialect, min_rate, max_rate.
    """
    reasons = [_reject(F.trim(F.col(f)) == "", f"missing {f}") for f in REQUIRED_FIELDS]
    reasons.append(F.when(~F.col("metric").rlike(text.SLUG_PATTERN), F.lit("metric is no slug")))
    present = set(contracts.columns)
    if "urn" in present:
        reasons.append(F.when(~F.col("urn").rlike(text.URN_PATTERN), F.lit("malformed urn")))
    if "version" in present:
        reasons.append(F.when(~F.col("version").rlike(text.SEMVER_PATTERN), F.lit("malformed version")))
    if "dialect" in present:
        reasons.append(F.when(~F.col("dialect").isin(*DIALECTS), F.lit("unknown dialect")))
    for bound in ("min_rate", "max_rate"):
        if bound in present:
            reasons.append(F.when(~F.col(bound).between(0.0, 1.0), F.lit(f"{bound} outside [0, 1]")))
    if {"min_rate", "max_rate"} <= present:
        reasons.append(F.when(F.col("min_rate") > F.col("max_rate"), F.lit("rate bounds crossed")))
    return contracts.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn(
        "accepted", F.size("reasons") == 0
    )


def with_domain(contracts: DataFrame) -> DataFrame:
    """Adds ``domain``: the declared one, else the first tag, else ``general``."""
    return contracts.withColumn("domain", F.coalesce(F.col("metadata")["domain"], F.get("tags", F.lit(0)), F.lit("general")))


def list_metrics(contracts: DataFrame, domain: str | None = None, allowed: Sequence[str] | None = None) -> DataFrame:
    """Metrics of one domain, within the domains the caller may see."""
    found = with_domain(contracts)
    if domain is not None:
        found = found.where(F.lower("domain") == domain.lower())
    if allowed is not None:
        found = found.where(F.col("domain").isin(*allowed))
    return found


def parse_reference(reference: Column) -> Column:
    """Struct (domain, metric, version, part) of a URN or of ``scheme://contracts/d/m/v[/part]``."""
    uri = r"^[a-z0-9]+://contracts/([^/]+)/([^/]+)/([^/]+)(?:/([^/]+))?$"
    is_uri = reference.rlike(uri)

    def group(i, urn_group=None):
        from_uri = F.nullif(F.regexp_extract(reference, uri, i), F.lit(""))
        if urn_group is None:
            return from_uri
        from_urn = F.nullif(F.regexp_extract(reference, text.URN_PATTERN, urn_group), F.lit(""))
        return F.when(is_uri, from_uri).otherwise(from_urn)

    return F.struct(
        group(1, 1).alias("domain"), group(2, 2).alias("metric"), group(3).alias("version"), group(4).alias("part")
    )


def resolve(references: DataFrame, column: str, contracts: DataFrame) -> DataFrame:
    """Attach the contract each reference names.

    A reference without a version takes the latest one; ``resolved`` is false where
    no contract answers.  Contracts are unique per (domain, metric, version).
    """
    parsed = references.withColumn("__ref", parse_reference(F.col(column)))
    offered = contracts.select(
        F.col("domain").alias("__d"), F.col("metric").alias("__m"), F.col("version").alias("__v"), F.lit(True).alias("__hit")
    )
    numbers = F.transform(F.split("__v", r"\."), lambda n: n.cast("int"))
    latest = offered.groupBy("__d", "__m").agg(F.max_by("__v", numbers).alias("__latest"))
    named = parsed.join(
        latest, (F.col("__ref.domain") == F.col("__d")) & (F.col("__ref.metric") == F.col("__m")), "left"
    ).drop("__d", "__m")
    exact = named.join(
        offered,
        (F.col("__ref.domain") == F.col("__d"))
        & (F.col("__ref.metric") == F.col("__m"))
        & (F.coalesce(F.col("__ref.version"), F.col("__latest")) == F.col("__v")),
        "left",
    )
    return exact.select(
        *references.columns,
        F.col("__ref.domain").alias("domain"),
        F.col("__ref.metric").alias("metric"),
        F.coalesce(F.col("__ref.version"), F.col("__latest")).alias("version"),
        F.col("__ref.part").alias("part"),
        F.coalesce("__hit", F.lit(False)).alias("resolved"),
    )


def declared_dimensions(contracts: DataFrame) -> Column:
    """What the contract declares, as the names used by the requirements."""
    inv = F.col("invariants")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    population = some(inv["population"]["required_filters"]) | some(inv["population"]["forbidden_filters"])
    components = some(inv["aggregation"]["positive_components"]) | some(inv["aggregation"]["negative_components"])
    timed = inv["time"]["timezone"].isNotNull() | inv["time"]["period_grain"].isNotNull()

    def names(flag, *labels):
        return F.when(flag, F.array(*[F.lit(x) for x in labels])).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(
        F.concat(
            names(population, "population", "exclusion_filter"),
            names(some(inv["grain"]["required_dimensions"]), "grain"),
            names(inv["aggregation"]["required_function"].isNotNull(), "aggregation"),
            names(components, "aggregation", "churn_definition", "cogs_component", "funnel_complete_event"),
            names(inv["units"]["currency"].isNotNull(), "currency"),
            names(timed, "time", "cohort_period", "clock_start"),
        )
    )


def coverage(declared: DataFrame, requirements: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Score of each contract against the requirements of its metric.

    Input: ``metric`` and ``declared`` (array).  Adds satisfied and missing
    dimensions, ``coverage_pct`` and ``comprehensive``.  An input column
    ``required`` takes the place of the requirements.
    """
    if "required" in declared.columns:
        required = F.col("required")
    else:
        table = DOMAIN_REQUIREMENTS if requirements is None else requirements
        required = F.array(*[F.lit(d) for d in GENERIC_REQUIREMENT])
        for metric, dims in table.items():
            required = F.when(F.lower("metric") == metric, F.array(*[F.lit(d) for d in dims])).otherwise(required)
    satisfied = F.array_sort(F.array_intersect(F.col("declared"), required))
    missing = F.array_sort(F.array_except(required, F.col("declared")))
    n_required = F.size(F.array_distinct(required))
    score = F.when(n_required == 0, F.lit(100.0)).otherwise(
        F.round(F.try_divide(F.size(satisfied).cast("double"), n_required.cast("double")) * 100.0, 1)
    )
    return declared.withColumns(
        {
            "satisfied": satisfied,
            "missing": missing,
            "coverage_pct": score,
            "comprehensive": score >= COMPREHENSIVE_PCT,
        }
    )
