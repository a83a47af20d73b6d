"""From variants and suites to scores: which faults does a suite catch?"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.stats import pct, ratio, wilson_interval
from plumbline.operators.assertions import Singular
from plumbline.operators.compare import DIGITS, EQUAL_PCT
from plumbline.operators.fused import run_fused
from plumbline.operators.percentiles import aggregate_with_percentiles
from plumbline.operators.suites import Suite, run_suite
from plumbline.plans.spec import MetricSpec
from plumbline.plans.variants import BASE, derive, run_variants
from plumbline.session import stored

# Outcome of one variant under one suite.
EQUIVALENT = "EQUIVALENT_ON_FIXTURE"
RUNTIME_ERROR = "RUNTIME_ERROR"
DETECTED = "VALID_DEFECT_DETECTED"
SURVIVED = "VALID_DEFECT_SURVIVED"

# Thresholds (adequacy, coverage) of the validity grades.
VALIDITY_POLICY = {"conclusive": (80.0, 60.0), "qualified": (60.0, 40.0)}

# Known root causes of surviving defects.
SURVIVOR_TAXONOMY = (
    # mutation_id, model, operator, root_cause_category, root_cause_code, missing dimension, severity
    ("ROAS_002", "ad_campaign_roas", "BOUNDARY_SHIFT", "MISSING_CONTRACT",
     "ATTRIBUTION_WINDOW_UNDECLARED", "temporal_attribution_window", "HIGH"),
    ("READMISSION_001", "hospital_readmission_rate", "FILTER_DROP", "MISSING_CONTRACT",
     "INDEX_ADMISSION_DENOMINATOR_UNCONSTRAINED", "cohort_eligibility", "HIGH"),
    ("TAKE_RATE_002", "marketplace_take_rate", "AGGREGATION_SWAP", "ASSERTION_GAP",
     "NUMERATOR_DENOMINATOR_LINKAGE_MISSING", "aggregation_tolerance", "MEDIUM"),
    ("CHARGEBACK_001", "fintech_chargeback_rate", "COALESCE_BYPASS", "MUTATION_ORACLE_GAP",
     "EQUIVALENT_ON_FIXTURE_DENOMINATOR", "null_policy", "LOW"),
)


def classification(error: Column, equivalent: Column, failed: Column) -> Column:
    """Outcome of a variant; ``failed`` is the array of failed assertion names."""
    return (
        F.when(error, RUNTIME_ERROR)
        .when(equivalent, EQUIVALENT)
        .when(F.size(failed) > 0, DETECTED)
        .otherwise(SURVIVED)
    )


def classify(evaluations: DataFrame) -> DataFrame:
    """Adds ``classification`` from ``runtime_error``, ``equivalent`` and ``assertions_failed``."""
    return evaluations.withColumn(
        "classification",
        classification(F.col("runtime_error"), F.col("equivalent"), F.col("assertions_failed")),
    )


def catch_scores(evaluations: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts and effective catch rate per group.

    generated = equivalent + unexecutable + valid and valid = detected + surviving.
    Without a valid defect the rate is not applicable and NULL.
    """
    def count_of(label):
        return F.count_if(F.col("classification") == label)

    counts = evaluations.groupBy(*by).agg(
        F.count(F.lit(1)).alias("generated"),
        count_of(EQUIVALENT).alias("equivalent"),
        count_of(RUNTIME_ERROR).alias("unexecutable"),
        count_of(DETECTED).alias("detected"),
        count_of(SURVIVED).alias("surviving"),
    )
    valid = F.col("detected") + F.col("surviving")
    return counts.withColumn("valid_defects", valid).withColumn(
        "effective_catch_pct", pct(F.col("detected"), F.col("valid_defects"))
    )


def incremental_gain(scores: DataFrame, standard: str, semantic: str, by: Sequence[str] = ("model",)) -> DataFrame:
    """Catch rate of the semantic suite minus that of the standard suite, per model."""
    def of(suite):
        return F.max(F.when(F.col("suite") == suite, F.col("effective_catch_pct")))

    both = scores.groupBy(*by).agg(of(standard).alias("standard_catch_pct"), of(semantic).alias("semantic_catch_pct"))
    return both.withColumn(
        "incremental_gain_pct", F.round(F.col("semantic_catch_pct") - F.col("standard_catch_pct"), 1)
    )


def pair_suites(evaluations: DataFrame, standard: str, semantic: str, keys: Sequence[str]) -> DataFrame:
    """The two suites' outcomes of the same variant side by side; variants in both only."""
    def of(suite, name):
        rows = evaluations.where(F.col("suite") == suite)
        return rows.select(*keys, F.col("classification").alias(name))

    return of(standard, "standard_outcome").join(of(semantic, "semantic_outcome"), list(keys))


def grade(scores: DataFrame, policy: Mapping[str, tuple[float, float]] = VALIDITY_POLICY) -> DataFrame:
    """Adds validity and confidence from ``fixture_adequacy_pct`` and ``contract_coverage_pct``."""
    def meets(level):
        adequacy, coverage = policy[level]
        return (F.col("fixture_adequacy_pct") >= adequacy) & (F.col("contract_coverage_pct") >= coverage)

    return scores.withColumns(
        {
            "validity": F.when(meets("conclusive"), "CONCLUSIVE")
            .when(meets("qualified"), "QUALIFIED")
            .otherwise("INCONCLUSIVE"),
            "confidence": F.when(meets("conclusive"), "HIGH").when(meets("qualified"), "MEDIUM").otherwise("LOW"),
        }
    )


def track_summary(scores: DataFrame, by: Sequence[str] = ("track",)) -> DataFrame:
    """Macro average, pooled rate with its Wilson interval, and certified models per track."""
    pooled = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("models"),
        F.round(F.avg("effective_catch_pct"), 1).alias("macro_catch_pct"),
        F.sum("detected").alias("detected"),
        F.sum("valid_defects").alias("valid_defects"),
        F.count_if(F.col("validity") == "CONCLUSIVE").alias("certified"),
    )
    low, high = wilson_interval(F.col("detected"), F.col("valid_defects"))
    return pooled.withColumns(
        {
            "pooled_catch_pct": pct(F.col("detected"), F.col("valid_defects")),
            "wilson_low_pct": F.round(low * 100.0, 1),
            "wilson_high_pct": F.round(high * 100.0, 1),
        }
    )


def false_positives(evaluations: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of equivalent variants that the suite flags all the same."""
    equivalent = F.col("classification") == EQUIVALENT
    flagged = F.count_if(equivalent & (F.size("assertions_failed") > 0))
    return evaluations.groupBy(*by).agg(
        F.count_if(equivalent).alias("equivalent"),
        flagged.alias("flagged"),
        ratio(flagged, F.count_if(equivalent)).alias("false_positive_rate"),
    )


def tier_verdicts(candidates: DataFrame) -> DataFrame:
    """Long form of the five tier verdicts: candidate columns, ``tier``, ``caught``.

    Input flags: syntax_ok, tier1_ok, project_ok, non_negative_ok, contract_ok,
    semantic_ok.  Tier 2 is only asked where tier 1 passed.
    """
    tiers = F.array(
        F.struct(F.lit(0).alias("tier"), (~F.col("syntax_ok")).alias("caught")),
        F.struct(F.lit(1).alias("tier"), (~F.col("tier1_ok")).alias("caught")),
        F.struct(
            F.lit(2).alias("tier"),
            F.when(F.col("tier1_ok"), ~(F.col("project_ok") & F.col("non_negative_ok"))).otherwise(True).alias("caught"),
        ),
        F.struct(F.lit(3).alias("tier"), (~F.col("contract_ok")).alias("caught")),
        F.struct(F.lit(4).alias("tier"), (~F.col("semantic_ok")).alias("caught")),
    )
    return candidates.select("*", F.inline(tiers))


def tier_flags(results: DataFrame, structure: DataFrame, contract: DataFrame, project: str, semantic: str) -> DataFrame:
    """The ladder's flags per variant, from tiers that were run.

    ``results``: :func:`assertion_results` of the suites named ``project`` and ``semantic``;
    ``structure`` (variant, passed): :func:`minimal_structural` of each; ``contract``
    (variant, passed): compliance of each variant's clauses.  Variants that cannot be
    planned are no candidates, so their syntax is sound.
    """
    def all_of(condition):
        return F.coalesce(F.bool_and(F.when(condition, F.col("passed"))), F.lit(True))

    suites = results.groupBy("variant").agg(
        all_of(F.col("suite") == project).alias("project_ok"),
        all_of(F.col("type") == "non_negative").alias("non_negative_ok"),
        all_of(F.col("suite") == semantic).alias("semantic_ok"),
    )
    tier1 = structure.select("variant", F.col("passed").alias("tier1_ok"))
    held = contract.select("variant", F.col("passed").alias("contract_ok"))
    return suites.join(tier1, "variant").join(held, "variant").withColumn("syntax_ok", F.lit(True))


def corpus_matrix(cases: Sequence[tuple[MetricSpec, DataFrame, Sequence[Suite], Mapping[str, DataFrame]]], strict: bool = True) -> DataFrame:
    """Kill matrices of many metrics, each over its own source and tables, as one table for the score functions."""
    return side_by_side([partial(kill_matrix, spec, df, suites, tables, strict) for spec, df, suites, tables in cases])


def side_by_side(matrices: Sequence[Callable[[], DataFrame]], at_once: int = 8) -> DataFrame:
    """The union of small results, each stored by its own job; ``at_once`` of them are planned and run together.

    The jobs of one matrix wait for each other, so a cluster would idle if they ran one after the other.
    """
    with ThreadPoolExecutor(at_once) as pool:
        parts = list(pool.map(lambda make: stored(make(), "matrix"), matrices))
    return reduce(DataFrame.unionByName, parts)


def ladder(verdicts: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Per tier: caught, valid, rate in percent and latency percentiles."""
    aggregates = [F.count_if("caught").alias("caught"), F.count(F.lit(1)).alias("valid")]
    tiers = aggregate_with_percentiles(verdicts, aggregates, latency, {"p50_ms": 0.5, "p95_ms": 0.95}, ["tier"])
    return tiers.select(
        "tier",
        "caught",
        "valid",
        pct(F.col("caught"), F.col("valid"), 2).alias("catch_rate_pct"),
        F.round("p50_ms", 2).alias("p50_ms"),
        F.round("p95_ms", 2).alias("p95_ms"),
    )


def minimal_structural(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tier 1: the result (or each slice of ``by``) is not empty and holds no NULL in any column."""
    columns = [c for c in df.columns if c not in by]
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(columns)]
    total = reduce(lambda a, b: a + b, [F.col(f"n{i}") for i in range(len(columns))])
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("rows"), *nulls)
        .select(*by, "rows", total.alias("null_cells"))
        .withColumn("passed", (F.col("rows") > 0) & (F.col("null_cells") == 0))
    )


def survivor_taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(SURVIVOR_TAXONOMY),
        "taxonomy_id string, model string, operator string, root_cause_category string, "
        "root_cause_code string, missing_dimension string, severity string",
    )


def explain_survivors(evaluations: DataFrame, taxonomy: DataFrame, model: str | None = None) -> DataFrame:
    """Surviving defects with their known root cause, where there is one."""
    survivors = evaluations.where(F.col("classification") == SURVIVED)
    if model is not None:
        survivors = survivors.where(F.col("model") == model)
    return survivors.join(taxonomy, ["model", "operator"], "left")


# The family each kind of assertion belongs to in the check matrix.
CHECK_FAMILIES = {
    "volume": ("row_count",),
    "nulls": ("not_null",),
    "schema": ("unique", "grain", "relationships"),
    "freshness": ("accepted_range", "accepted_values"),
    "value": ("metric_value", "non_negative", "population", "singular_sql_test"),
}


def check_matrix(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per variant: verdict of each check family, and whether all of them were blind.

    A family without an assertion has no verdict.
    """
    def family(kinds):
        return F.bool_and(F.when(F.col("type").isin(*kinds), F.col("passed")))

    verdicts = [family(kinds).alias(f"{name}_ok") for name, kinds in CHECK_FAMILIES.items()]
    return (
        results.groupBy(*by)
        .agg(*verdicts, F.bool_or(~F.col("passed")).alias("caught"))
        .withColumn("blind_spot", ~F.col("caught"))
    )


def _variant_diffs(long: DataFrame, spec: MetricSpec, faults: Sequence[str]) -> DataFrame:
    """Per variant: row counts, change of the measure total, and differing rows.

    Base rows are repeated per variant and cancel against equal variant rows in
    one aggregate.  What is aggregated is the metric's result, not its source.
    """
    values = [F.round(F.col(m), DIGITS).alias(m) for m in spec.measure_names]
    is_base = F.col("variant") == BASE
    against = F.when(is_base, F.array(*[F.lit(f) for f in faults])).otherwise(F.array("variant"))
    stacked = long.select(*spec.dim_names, *values, is_base.alias("b"), F.explode(against).alias("variant"))
    rows = stacked.groupBy("variant", *spec.dim_names, *spec.measure_names).agg(
        F.count_if("b").alias("nb"), F.count_if(~F.col("b")).alias("nv")
    )
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(m), F.lit(0.0)) for m in spec.measure_names])
    sums = rows.groupBy("variant").agg(
        F.sum("nb").alias("base_rows"),
        F.sum("nv").alias("variant_rows"),
        F.sum(F.col("nb") * total).alias("base_total"),
        F.sum(F.col("nv") * total).alias("variant_total"),
        F.sum(F.abs(F.col("nb") - F.col("nv"))).alias("differing_rows"),
    )
    old, new = F.col("base_total"), F.col("variant_total")
    by_value = F.when(old != 0, F.abs(new - old) / F.abs(old) * 100.0).otherwise(
        F.when(new == 0, F.lit(0.0)).otherwise(F.lit(100.0))
    )
    by_rows = (
        F.abs(F.col("variant_rows") - F.col("base_rows")) / F.greatest(F.col("base_rows"), F.lit(1)) * 100.0
    )
    same_shape = (F.col("base_rows") == F.col("variant_rows")) & (F.col("variant") != "GRAIN_DROP")
    change = F.when(same_shape, by_value).otherwise(by_rows)
    return sums.select(
        "variant",
        "base_rows",
        "variant_rows",
        "differing_rows",
        F.round(change, DIGITS).alias("variance_pct"),
        (same_shape & (change < EQUAL_PCT)).alias("equal_total"),
    )


def assertion_results(long: DataFrame, suites: Sequence[Suite], tables: Mapping[str, DataFrame], faults: Sequence[str]) -> DataFrame:
    """suite, variant, name, type, passed: every assertion of every suite on every variant.

    Each suite runs once over ``long``, sliced by variant.  What it does not report is
    filled in from the suite's own list: an assertion with a shuffle of its own has no
    row for a slice without finding, and a variant without any row is judged as an empty
    result (on no table at all: only the row-local assertions can object to that).
    """
    spark = long.sparkSession
    empty = spark.createDataFrame([], long.drop("variant").schema)
    every, found, on_empty = [], [], []
    for suite in suites:
        every += [(suite.name, a.label, a.kind, f) for a in suite.assertions for f in faults]
        sliced = Suite(suite.name, [a for a in suite.assertions if not isinstance(a, Singular)])
        single = Suite(suite.name, [a for a in suite.assertions if isinstance(a, Singular)])
        if sliced.assertions:
            found.append(run_suite(long, sliced, tables, ["variant"]).select("suite", "variant", "name", "passed"))
        for fault in faults if single.assertions else ():
            part = run_suite(long.where(F.col("variant") == fault).drop("variant"), single, tables)
            found.append(part.select("suite", F.lit(fault).alias("variant"), "name", "passed"))
        local = [c for a in sliced.assertions if not a.is_skipped(empty, tables) for c in [a.fused(suite.name, empty)] if c is not None]
        if local:
            on_empty.append(run_fused(empty, local).select("suite", "name", F.col("passed").alias("__empty")))
    rows = spark.createDataFrame(every, "suite string, name string, type string, variant string")
    rows = rows.join(reduce(DataFrame.unionByName, found), ["suite", "name", "variant"], "left")
    if on_empty:
        rows = rows.join(reduce(DataFrame.unionByName, on_empty), ["suite", "name"], "left")
    else:
        rows = rows.withColumn("__empty", F.lit(True))
    return rows.withColumn("passed", F.coalesce("passed", "__empty", F.lit(True))).drop("__empty")


def kill_matrix(
    spec: MetricSpec,
    df: DataFrame,
    suites: Sequence[Suite],
    tables: Mapping[str, DataFrame] | None = None,
    strict: bool = True,
) -> DataFrame:
    """Every variant under every suite: how it differs and which assertions noticed.

    One scan of the source computes base and all variants.  The result, one row
    per group and variant, is stored in the shared folder of the cluster; each
    suite then runs once over it, sliced by variant.
    ``strict`` takes any differing row as a change; otherwise only the totals are
    compared, which overlooks permuted values.
    """
    spark = df.sparkSession
    variants = derive(spec, df)
    runnable = [v.fault for v in variants if v.error is None]
    long = stored(run_variants(spec, df, store=True), f"long-variants-{spec.name}")
    diffs = _variant_diffs(long, spec, runnable)
    equivalent = (F.col("differing_rows") == 0) if strict else F.col("equal_total")
    diffs = diffs.withColumn("equivalent", equivalent).withColumn("runtime_error", F.lit(False))
    results = assertion_results(long, suites, dict(tables or {}), runnable)
    failed = results.groupBy("suite", "variant").agg(
        F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("name")))).alias("assertions_failed")
    )
    evaluated = diffs.join(failed, "variant")
    broken = [v.fault for v in variants if v.error is not None]
    if broken:
        rows = [(s.name, fault) for s in suites for fault in broken]
        errors = spark.createDataFrame(rows, "suite string, variant string").withColumns(
            {"runtime_error": F.lit(True), "equivalent": F.lit(False), "assertions_failed": F.array().cast("array<string>")}
        )
        evaluated = evaluated.unionByName(errors, allowMissingColumns=True)
    return classify(evaluated).select(
        F.lit(spec.name).alias("model"),
        "suite",
        F.col("variant").alias("operator"),
        "base_rows",
        "variant_rows",
        "differing_rows",
        "variance_pct",
        "equivalent",
        "runtime_error",
        "assertions_failed",
        "classification",
    )
