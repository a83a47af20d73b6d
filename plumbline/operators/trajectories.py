"""Agent trajectories: grading, scorecards, replay and confusion matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import pct
from plumbline.functions.text import text_hash
from plumbline.operators.percentiles import aggregate_with_percentiles

# Behaviours under which any SQL is a breach, and the benefit weights.
NO_SQL_BEHAVIOURS = ("ABSTAIN", "ASK_CLARIFICATION", "REQUIRE_REVIEW")
NET_BENEFIT_WEIGHTS = {"latency": 0.1, "cost": 0.5, "abstention": 0.2}


def appropriate_abstention(abstained: Column, expected_behavior: Column) -> Column:
    return abstained & F.coalesce(expected_behavior.isin(*NO_SQL_BEHAVIOURS), F.lit(False))


def grade_trajectories(trajectories: DataFrame, scenarios: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Replace the logged flags by verdicts on the SQL the run ended with.

    trajectories: scenario_id, final_sql_hash, abstained, ...
    scenarios: scenario_id, expected_behavior, has_contract, has_golden, ...
    verdicts: sql_hash, scenario_id, ran, contract_passed, matches_golden; one
    row per pair.  Runs of unknown scenarios are dropped, an SQL without a
    verdict did not run.
    """
    known = trajectories.drop("execution_success", "contract_compliant", "result_correct").join(
        scenarios, "scenario_id"
    )
    judged = known.join(
        verdicts.withColumnRenamed("sql_hash", "final_sql_hash"), ["scenario_id", "final_sql_hash"], "left"
    )
    wrote_sql = F.col("final_sql_hash").isNotNull()
    ran = wrote_sql & F.coalesce("ran", F.lit(False))
    compliant = (
        F.when(~wrote_sql, False)
        .when(F.col("expected_behavior").isin(*NO_SQL_BEHAVIOURS), False)
        .when(~F.col("has_contract"), True)
        .otherwise(F.coalesce("contract_passed", F.lit(False)))
    )
    correct = ran & F.col("has_golden") & F.coalesce("matches_golden", F.lit(False))
    return judged.withColumns(
        {
            "execution_success": ran,
            "contract_compliant": compliant,
            "result_correct": correct,
            "appropriate_abstention": appropriate_abstention(F.col("abstained"), F.col("expected_behavior")),
        }
    ).drop("ran", "contract_passed", "matches_golden")


def valid_goldens(scenarios: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Is each scenario's golden answer sound?  Adds ``golden_valid``.

    scenarios: scenario_id, golden_sql_hash, expected_behavior, has_contract,
    fixture_fingerprint (NULL: not checked).
    verdicts: scenario_id, ran, contract_passed, fingerprint.
    """
    joined = scenarios.join(verdicts, "scenario_id", "left")
    sound = (
        F.coalesce("ran", F.lit(False))
        & (~F.col("has_contract") | F.coalesce("contract_passed", F.lit(False)))
        & (
            F.col("fixture_fingerprint").isNull()
            | F.coalesce(F.col("fixture_fingerprint") == F.col("fingerprint"), F.lit(False))
        )
    )
    return joined.withColumn(
        "golden_valid",
        F.when(F.col("golden_sql_hash").isNull(), F.col("expected_behavior") != "PRODUCE_SQL").otherwise(sound),
    ).select(*scenarios.columns, "golden_valid")


def scorecard(trajectories: DataFrame, by: Sequence[str] = ("agent_type",)) -> DataFrame:
    """Rates, mean tool calls, latency percentiles and mean cost per group."""
    def share(flag):
        return F.round(F.avg(F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0))), 4)

    aggregates = [
        F.count(F.lit(1)).alias("total_evaluations"),
        share(F.col("execution_success")).alias("execution_success_rate"),
        share(F.col("contract_compliant")).alias("contract_compliance_rate"),
        share(F.col("result_correct")).alias("result_correctness_rate"),
        share(F.col("execution_success") & ~F.col("contract_compliant")).alias("unsafe_query_rate"),
        share(F.col("abstained")).alias("abstention_rate"),
        share(F.col("appropriate_abstention")).alias("appropriate_abstention_rate"),
        share(F.col("ceiling_reached")).alias("ceiling_reached_rate"),
        F.round(F.avg(F.size("tool_calls")), 2).alias("mean_tool_calls"),
        F.round(F.avg(F.coalesce("estimated_cost_usd", F.lit(0.0))), 4).alias("mean_cost_usd"),
    ]
    probabilities = {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}
    cards = aggregate_with_percentiles(trajectories, aggregates, "latency_ms", probabilities, by)
    return cards.withColumns({p: F.round(p, 2) for p in probabilities})


def lift(cards: DataFrame, weights: Mapping[str, float] = NET_BENEFIT_WEIGHTS, blind: str = "blind", governed: str = "governed") -> DataFrame:
    """One row: semantic lift and net benefit of the governed agent over the blind one."""
    def of(side, column):
        return F.coalesce(F.max(F.when(F.col("agent_type") == side, F.col(column))), F.lit(0.0))

    def delta(column):
        return of(governed, column) - of(blind, column)

    inappropriate = of(governed, "abstention_rate") - of(governed, "appropriate_abstention_rate")
    net = (
        delta("result_correctness_rate")
        - weights["latency"] * delta("p95_latency_ms") / 1000.0
        - weights["cost"] * delta("mean_cost_usd")
        - weights["abstention"] * inappropriate
    )
    return cards.agg(
        F.round(delta("contract_compliance_rate"), 4).alias("semantic_lift"),
        F.round(net, 4).alias("net_governance_benefit"),
    )


def replay(trajectories: DataFrame, scenarios: DataFrame, artifacts: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Re-grade logged runs: (graded runs, one-row count of runs by fate).

    A run whose SQL is not in the artifact store cannot be replayed; a run of an
    unknown scenario is skipped.
    """
    stored = artifacts.select(F.col("sql_hash").alias("final_sql_hash"), F.lit(True).alias("__stored"))
    known = scenarios.select("scenario_id", F.lit(True).alias("__known"))
    fated = trajectories.join(known, "scenario_id", "left").join(stored, "final_sql_hash", "left")
    fate = (
        F.when(F.col("__known").isNull(), "unknown_scenario")
        .when(F.col("final_sql_hash").isNotNull() & F.col("__stored").isNull(), "unreplayable")
        .otherwise("replayed")
    )
    fated = fated.withColumn("__fate", fate)
    replayable = fated.where(F.col("__fate") == "replayed").drop("__fate", "__known", "__stored")
    counts = fated.agg(
        F.count_if(F.col("__fate") == "replayed").alias("replayed"),
        F.count_if(F.col("__fate") == "unreplayable").alias("unreplayable"),
        F.count_if(F.col("__fate") == "unknown_scenario").alias("unknown_scenario"),
    )
    return grade_trajectories(replayable, scenarios, verdicts), counts


def outcome_class(success: Column, compliant: Column, matches: Column) -> Column:
    """Cell of the compliance-by-result matrix; NULL verdicts are unresolved."""
    return (
        F.when(~success, "EXECUTION_ERROR")
        .when(compliant & matches, "CONTRACT_COMPLIANT_RESULT_MATCH")
        .when(compliant & ~matches, "CONTRACT_COMPLIANT_RESULT_MISMATCH")
        .when(~compliant & matches, "CONTRACT_VIOLATION_RESULT_MATCH")
        .when(~compliant & ~matches, "CONTRACT_VIOLATION_RESULT_MISMATCH")
        .otherwise("UNRESOLVED_CONTRACT")
    )


def confusion(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the matrix cells from execution_success, contract_compliant, result_correct."""
    cell = outcome_class(F.col("execution_success"), F.col("contract_compliant"), F.col("result_correct"))
    names = {
        "compliant_match": "CONTRACT_COMPLIANT_RESULT_MATCH",
        "compliant_mismatch": "CONTRACT_COMPLIANT_RESULT_MISMATCH",
        "violation_match": "CONTRACT_VIOLATION_RESULT_MATCH",
        "violation_mismatch": "CONTRACT_VIOLATION_RESULT_MISMATCH",
        "execution_error": "EXECUTION_ERROR",
        "unresolved": "UNRESOLVED_CONTRACT",
    }
    return (
        records.withColumn("__cell", cell)
        .groupBy(*by)
        .agg(*[F.count_if(F.col("__cell") == label).alias(name) for name, label in names.items()])
    )


def agent_report(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Success, compliance and correctness in percent, with latency mean and percentiles."""
    def rate_of(flag):
        return pct(F.count_if(F.col(flag)), F.count(F.lit(1)))

    aggregates = [
        F.count(F.lit(1)).alias("total_evaluations"),
        rate_of("execution_success").alias("execution_success_pct"),
        rate_of("contract_compliant").alias("contract_compliance_pct"),
        rate_of("result_correct").alias("result_correctness_pct"),
        F.round(F.avg("latency_ms"), 2).alias("mean_ms"),
    ]
    probabilities = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    report = aggregate_with_percentiles(records, aggregates, "latency_ms", probabilities, by)
    return report.withColumns({p: F.round(p, 2) for p in probabilities})


def redact(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace raw texts by ``<name>_hash``; the raw columns are gone."""
    hashed = rows.withColumns({f"{c}_hash": text_hash(F.col(c)) for c in columns})
    return hashed.drop(*columns)
