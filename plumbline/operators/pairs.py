"""Preference pairs from evaluated variants: gates, splits, layouts and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.governance import check_compliance
from plumbline.plans.variants import BASE

# Fault families of each split, and domains kept out of training.
SPLIT_FAULTS = {
    "train": ("FILTER_DROP", "AGGREGATION_SWAP", "COALESCE_BYPASS"),
    "validation": ("BOUNDARY_SHIFT", "DISTINCT_DROP"),
    "holdout": ("GRAIN_DROP", "MATH_OPERATOR_INVERT", "JOIN_PREDICATE_DROP"),
}
HOLDOUT_DOMAINS = ("healthcare", "infrastructure", "risk")
REWARD_POLICY = "reward-v1"


def family_split(family: Column) -> Column:
    """70 / 15 / 15 split by the md5 of the metric family; a family never crosses splits."""
    bucket = F.conv(F.substring(F.md5(family), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(bucket < 70, "train").when(bucket < 85, "validation").otherwise("holdout")


def rule_split(domain: Column, fault: Column) -> Column:
    """Split by domain first, then by fault family."""
    return (
        F.when(F.lower(domain).isin(*HOLDOUT_DOMAINS), "holdout")
        .when(F.upper(fault).isin(*SPLIT_FAULTS["holdout"]), "holdout")
        .when(F.upper(fault).isin(*SPLIT_FAULTS["validation"]), "val")
        .otherwise("train")
    )


def difficulty(fault: Column) -> Column:
    name = F.upper(fault)
    return (
        F.when(name.isin("FILTER_DROP", "AGGREGATION_SWAP", "COALESCE_BYPASS"), "easy")
        .when(name.isin("BOUNDARY_SHIFT", "DISTINCT_DROP", "GRAIN_DROP"), "medium")
        .otherwise("hard")
    )


def difficulty_reasons(fault: Column, n_required_filters: Column) -> Column:
    level = difficulty(fault)
    reason = (
        F.when(level == "easy", "direct_ast_mutation")
        .when(level == "medium", "subtle_boundary_or_grain_shift")
        .otherwise("relational_or_deduction_inversion")
    )
    return F.array_compact(F.array(reason, F.when(n_required_filters > 2, F.lit("multi_component_metric"))))


def calibrated_difficulty(fault: Column, variance_pct: Column, subtle: Column | None = None) -> Column:
    """Four levels, by fault and by how little the result moves."""
    name = F.upper(fault)
    moved_little = (F.abs(variance_pct) > 0.0) & (F.abs(variance_pct) <= 5.0)
    hard = name.isin("GRAIN_DROP", "BOUNDARY_SHIFT") | F.coalesce(moved_little, F.lit(False))
    if subtle is not None:
        hard = hard | subtle
    return (
        F.when(name.isin("JOIN_PREDICATE_DROP", "MATH_OPERATOR_INVERT"), "expert")
        .when(hard, "hard")
        .when(name.isin("FILTER_DROP", "COALESCE_BYPASS"), "medium")
        .otherwise("easy")
    )


def gate(candidates: DataFrame, require_divergence: bool = True, by_split: bool = True) -> DataFrame:
    """Adds ``rejection`` (NULL for a pair that is kept) and ``rejection_basis``.

    Input: chosen_sql, rejected_sql, executable, equivalent, result_changed,
    n_violations, mutation_type, split.  Reasons are tested in a fixed order.
    Kept pairs violate the contract and, by default, change the result.
    """
    changed, violated = F.col("result_changed"), F.col("n_violations") > 0
    reason = F.when(F.trim("chosen_sql") == F.trim("rejected_sql"), "identical_pair")
    if by_split:
        # a fault reserved for another split is never offered in this one
        allowed = F.lit(False)
        for split, faults in SPLIT_FAULTS.items():
            allowed = allowed | ((F.col("split") == split) & F.upper("mutation_type").isin(*faults))
        reason = reason.when(~allowed, "outside_split")
    reason = (
        reason.when(~F.col("executable"), "unexecutable")
        .when(F.col("equivalent"), "equivalent_on_fixture")
        .when(~changed & ~violated, "rejected_not_semantically_divergent")
        .when(changed & ~violated, "unresolved_preference")
    )
    if require_divergence:
        reason = reason.when(~changed, "rejected_not_semantically_divergent")
    basis = F.array_compact(
        F.array(F.when(violated, F.lit("CONTRACT_VIOLATION")), F.when(changed, F.lit("RESULT_DIVERGENCE")))
    )
    return candidates.withColumns({"rejection": reason, "rejection_basis": basis})


def rejection_counts(gated: DataFrame) -> DataFrame:
    return gated.groupBy(F.coalesce("rejection", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("pairs"))


def with_evidence(kept: DataFrame) -> DataFrame:
    """Adds both evidence structs and the sha256 of their canonical JSON (sorted keys)."""
    chosen = F.struct(
        F.lit(True).alias("assertions_passed"),
        F.lit(True).alias("baseline_validated"),
        F.lit(True).alias("contract_compliant"),
        F.lit(True).alias("execution_success"),
        F.lit("baseline").alias("result_reference"),
    )
    rejected = F.struct(
        F.lit(False).alias("assertions_passed"),
        (F.col("n_violations") == 0).alias("contract_compliant"),
        F.lit(True).alias("execution_success"),
        F.col("rejection_basis"),
        F.col("result_changed").alias("result_changed_vs_chosen"),
        F.round("variance_pct", 2).alias("variance_pct_vs_chosen"),
        F.col("violations"),
    )
    rows = kept.withColumns({"chosen_evidence": chosen, "rejected_evidence": rejected})
    payload = F.to_json(
        F.struct(
            F.col("chosen_evidence").alias("chosen"),
            F.col("metric"),
            F.col("mutation_type").alias("mutation"),
            F.col("rejected_evidence").alias("rejected"),
        ),
        {"ignoreNullFields": "false"},
    )
    return rows.withColumn("evidence_hash", F.sha2(payload, 256))


def prompt_text() -> Column:
    """The contract's description, else a default request naming metric, owner and grain."""
    return F.coalesce(
        F.col("description"),
        F.format_string(
            "Write a production-grade SQL query to calculate '%s' for owner '%s' at '%s' granularity.",
            "metric",
            "owner",
            "grain",
        ),
    )


def pair_rows(kept: DataFrame, policy_version: str = "1.0.0", fixture_id: str = "synthetic") -> DataFrame:
    """Pair rows from gated candidates joined with their contract's fields."""
    return with_evidence(kept).select(
        F.concat_ws("_", "metric", F.lower("mutation_type")).alias("example_id"),
        prompt_text().alias("prompt"),
        F.col("metric").alias("contract_id"),
        F.coalesce("contract_version", F.lit("1.0.0")).alias("contract_version"),
        F.trim("chosen_sql").alias("chosen_sql"),
        F.trim("rejected_sql").alias("rejected_sql"),
        "mutation_type",
        "chosen_evidence",
        "rejected_evidence",
        difficulty(F.col("mutation_type")).alias("difficulty"),
        difficulty_reasons(F.col("mutation_type"), F.col("n_required_filters")).alias("difficulty_reasons"),
        F.lit(fixture_id).alias("fixture_id"),
        F.lit(policy_version).alias("policy_version"),
        "evidence_hash",
        "split",
        "metric_family",
    )


def pair_candidates(evaluations: DataFrame, contracts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Every catalogued variant next to its metric's base, with what the contract and the kill matrix say of it.

    ``evaluations``: rows of a kill matrix (its suites agree on results); ``contracts``:
    one row per metric with metric_id, description, owner, grain, contract_version,
    metric_family and the rule columns of :func:`check_compliance`; ``catalogue``: the
    metrics' text.  Variants the matrix does not have count as not executable.
    """
    checked = check_compliance(catalogue.withColumnRenamed("metric", "metric_id"), contracts).select(
        F.col("metric_id").alias("metric"), "variant", "sql", "description", "known_metric", "passed", "violations"
    )
    base = checked.where(F.col("variant") == BASE).select("metric", F.col("sql").alias("chosen_sql"), F.col("passed").alias("chosen_passed"))
    results = evaluations.groupBy(F.col("model").alias("metric"), F.col("operator").alias("variant")).agg(
        F.max("base_rows").alias("base_rows"),
        F.max("variance_pct").alias("variance_pct"),
        F.bool_or("equivalent").alias("equivalent"),
        F.bool_or("runtime_error").alias("runtime_error"),
    )
    terms = contracts.select(
        F.col("metric_id").alias("metric"),
        "description",
        "owner",
        "grain",
        "contract_version",
        F.coalesce("metric_family", "metric_id").alias("metric_family"),
        F.coalesce(F.size("required_filters"), F.lit(0)).alias("n_required_filters"),
    )
    rows = checked.where(F.col("variant") != BASE).withColumnsRenamed({"sql": "rejected_sql", "description": "mutation_description"})
    joined = rows.join(base, "metric", "left").join(terms, "metric", "left").join(results, ["metric", "variant"], "left")
    return joined.select(
        "metric",
        F.col("variant").alias("mutation_type"),
        "mutation_description",
        "chosen_sql",
        "rejected_sql",
        "description",
        "owner",
        "grain",
        "contract_version",
        "metric_family",
        "n_required_filters",
        family_split(F.coalesce("metric_family", "metric")).alias("split"),
        "known_metric",
        "chosen_passed",
        "base_rows",
        F.coalesce("variance_pct", F.lit(0.0)).alias("variance_pct"),
        F.coalesce(~F.col("runtime_error"), F.lit(False)).alias("executable"),
        F.coalesce("equivalent", F.lit(False)).alias("equivalent"),
        F.coalesce(~F.col("runtime_error") & ~F.col("equivalent"), F.lit(False)).alias("result_changed"),
        F.transform("violations", lambda v: F.concat_ws(": ", v["category"], v["rule"])).alias("violations"),
        F.size("violations").alias("n_violations"),
    )


def gate_metrics(candidates: DataFrame, require_divergence: bool = True, by_split: bool = True) -> DataFrame:
    """:func:`gate` after what rules out a whole metric: an incomplete contract, a base without rows, a base that breaks its own contract."""
    complete = F.col("known_metric")
    for field in ("owner", "grain"):
        complete = complete & (F.trim(F.coalesce(field, F.lit(""))) != "")
    of_metric = (
        F.when(~complete, "incomplete_contract")
        .when(F.col("base_rows") == 0, "insufficient_fixture_contrast")
        .when(~F.col("chosen_passed"), "chosen_contract_failure")
    )
    gated = gate(candidates, require_divergence, by_split)
    return gated.withColumn("rejection", F.coalesce(of_metric, "rejection"))


def build_pairs(
    evaluations: DataFrame,
    contracts: DataFrame,
    catalogue: DataFrame,
    require_divergence: bool = True,
    by_split: bool = True,
    policy_version: str = "1.0.0",
    fixture_id: str = "synthetic",
) -> tuple[DataFrame, DataFrame]:
    """(pairs, rejects) from kill matrices, contracts and the catalogue of variants; see :func:`pair_candidates`.

    Every variant of every catalogued metric is in exactly one of the two; rejects carry
    the first reason that applies.
    """
    gated = gate_metrics(pair_candidates(evaluations, contracts, catalogue), require_divergence, by_split)
    rejects = gated.where(F.col("rejection").isNotNull()).select("metric", "mutation_type", "mutation_description", "chosen_sql", "rejected_sql", "split", "violations", "rejection")
    return pair_rows(gated.where(F.col("rejection").isNull()), policy_version, fixture_id), rejects


def _metadata(*names: str) -> Column:
    return F.struct(*names)


def format_dpo(pairs: DataFrame) -> DataFrame:
    meta = F.struct(
        "example_id",
        "contract_id",
        "mutation_type",
        "difficulty",
        "evidence_hash",
        "split",
        F.col("rejected_evidence.rejection_basis").alias("rejection_basis"),
    )
    return pairs.select(
        "prompt", F.col("chosen_sql").alias("chosen"), F.col("rejected_sql").alias("rejected"), meta.alias("metadata")
    )


def format_sft(pairs: DataFrame, with_rationale: bool = False) -> DataFrame:
    codes = F.array_compact(
        F.array(
            F.when(F.col("chosen_evidence.contract_compliant"), F.lit("CONTRACT_COMPLIANT")),
            F.when(F.col("chosen_evidence.assertions_passed"), F.lit("ASSERTIONS_PASSED")),
        )
    )
    columns = [
        F.col("prompt"),
        F.col("chosen_sql").alias("completion"),
        codes.alias("reason_codes"),
        _metadata("example_id", "contract_id", "difficulty", "evidence_hash").alias("metadata"),
    ]
    if with_rationale:
        rationale = F.format_string("Avoids %s: %s", "mutation_type", F.array_join("difficulty_reasons", ", "))
        columns.insert(2, rationale.alias("rationale"))
    return pairs.select(*columns)


def format_rlhf(pairs: DataFrame, both: bool = False, policy: str = REWARD_POLICY) -> DataFrame:
    """One rewarded response per pair, or with ``both`` the rejected one as well."""
    meta = _metadata("example_id", "contract_id", "difficulty", "evidence_hash").alias("metadata")

    def response(sql, execution, contract, assertions, divergence):
        return F.struct(
            F.col(sql).alias("response"),
            F.struct(
                execution.cast("double").alias("execution"),
                contract.cast("double").alias("contract"),
                assertions.cast("double").alias("assertions"),
                divergence.cast("double").alias("fixture_divergence"),
                F.lit(None).cast("double").alias("cost"),
            ).alias("reward_components"),
        )

    one, zero = F.lit(1.0), F.lit(0.0)
    responses = [response("chosen_sql", one, one, one, zero)]
    if both:
        evidence = F.col("rejected_evidence")
        responses.append(
            response(
                "rejected_sql",
                evidence["execution_success"],
                evidence["contract_compliant"],
                evidence["assertions_passed"],
                evidence["result_changed_vs_chosen"],
            )
        )
    return pairs.select("prompt", F.inline(F.array(*responses)), F.lit(policy).alias("reward_policy_version"), meta)


FORMATS = {"dpo": format_dpo, "sft": format_sft, "rlhf": format_rlhf}


def audit_integrity(pairs: DataFrame, order: str = "example_id") -> DataFrame:
    """One row of defect counts.

    Duplicates are rows beyond the first of a value.  A conflict is a row whose
    chosen text differs from that of the first row (by ``order``) of its prompt.
    Every count is an aggregate of pre-counted values, so a prompt or a hash that
    fills a third of the table costs one row per task.
    """
    def surplus(column):
        held = pairs.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        return held.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n")).scalar()

    answers = pairs.groupBy("prompt", F.trim("chosen_sql").alias("chosen")).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first")
    )
    conflicts = (
        answers.groupBy("prompt")
        .agg((F.sum("n") - F.min_by("n", "first")).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))
    )

    def missing(column):
        return F.count_if(F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == "")

    local = pairs.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.trim("chosen_sql") == F.trim("rejected_sql")).alias("chosen_rejected_identical"),
        (missing("example_id") + missing("evidence_hash")).alias("missing_evidence"),
        missing("contract_version").alias("missing_contract_versions"),
        missing("fixture_id").alias("missing_fixture_ids"),
    )
    return local.select(
        "*",
        surplus("example_id").alias("duplicate_example_ids"),
        surplus("evidence_hash").alias("duplicate_evidence_hashes"),
        conflicts.scalar().alias("conflicting_preference_labels"),
    )


def audit_leakage(pairs: DataFrame) -> DataFrame:
    """One row: holdout faults and domains inside train, and families in several splits."""
    in_train = F.col("split") == "train"
    splits = pairs.select("metric_family", "split").distinct().groupBy("metric_family").agg(F.count(F.lit(1)).alias("n"))
    families = splits.agg(F.count_if(F.col("n") > 1).alias("n")).scalar()
    return pairs.agg(
        F.count_if(in_train & F.col("mutation_type").isin(*SPLIT_FAULTS["holdout"])).alias("mutation_family_leakage"),
        F.count_if(in_train & F.lower("domain").isin(*HOLDOUT_DOMAINS)).alias("domain_leakage"),
    ).select("*", families.alias("metric_family_leakage"))


CLEAN_IF_ZERO = (
    "duplicate_example_ids",
    "duplicate_evidence_hashes",
    "conflicting_preference_labels",
    "chosen_rejected_identical",
    "missing_evidence",
    "mutation_family_leakage",
    "metric_family_leakage",
    "domain_leakage",
)


def audit_pairs(pairs: DataFrame, order: str = "example_id") -> DataFrame:
    """One-row report of integrity and leakage with the overall ``is_clean`` flag."""
    leaks = ("mutation_family_leakage", "domain_leakage", "metric_family_leakage")
    one = audit_leakage(pairs).select(F.struct(*leaks).alias("leaks")).scalar()
    report = audit_integrity(pairs, order).select("*", *[one.getField(c).alias(c) for c in leaks])
    clean = F.lit(True)
    for column in CLEAN_IF_ZERO:
        clean = clean & (F.col(column) == 0)
    return report.withColumn("is_clean", clean)


def distribution(pairs: DataFrame, columns: Sequence[str] = ("mutation_type", "difficulty", "split")) -> DataFrame:
    """Count and share of every value of the columns, in one pass over the table."""
    long = pairs.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    )
    total = pairs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "share_pct", F.round(F.col("rows") / total.cast("double") * 100.0, 1)
    )
