"""Distribution probes: has a source table drifted from what the contract assumes?

All probes of all contracts on one table share one scan.  Every probe yields a
row; ``alert`` tells whether it left its tolerance.  With ``by`` the same rates
are taken per slice, with a grouped aggregate instead of a global one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import rate
from plumbline.operators.fused import FusedCheck, run_fused

# Causes named by each kind of alert.
POPULATION_CAUSES = (
    "Upstream status mapping changed in source CRM/database",
    "Cohort segmentation query filter shifted",
    "Fixture / production sample population mix shifted",
)
NULL_CAUSES = (
    "Upstream ETL pipeline partial failure",
    "Schema migration or unhandled column rename",
    "Source system API payload schema changes",
)
ACTION = "Human review required to confirm if upstream definition changed."


def _causes(texts: Sequence[str]) -> Column:
    return F.array(*[F.lit(t) for t in texts])


def _alert_row(contract: str, signal: str, baseline: Column, current: Column, change: Column,
               confidence: Column, alert: Column, causes: Sequence[str], matches: Column, total: Column) -> Column:
    return F.struct(
        F.lit(contract).alias("contract"),
        F.lit(signal).alias("signal_type"),
        F.round(baseline.cast("double"), 4).alias("baseline"),
        F.round(current, 4).alias("current"),
        F.round(change, 1).alias("relative_change"),
        F.when(alert, confidence).alias("confidence"),
        alert.alias("alert"),
        matches.cast("bigint").alias("matches"),
        total.cast("bigint").alias("total"),
        F.when(alert, _causes(causes)).alias("likely_causes"),
        F.when(alert, F.lit(ACTION)).alias("action_required"),
    )


def _relative_change(current: Column, baseline: float) -> Column:
    if baseline <= 0:
        return F.lit(0.0)
    return (current - baseline) / F.lit(float(baseline)) * 100.0


@dataclass(frozen=True)
class PopulationProbe:
    """Share of rows with ``column = target`` (or NULL for ``target=None``) stays near the baseline."""

    contract: str
    column: str
    target: object
    baseline_rate: float
    tolerance: float = 0.05

    def check(self) -> FusedCheck:
        column = F.col(self.column)
        flag = column.isNull() if self.target is None else column == F.lit(self.target)

        def row(pick):
            current = rate(pick("matches"), pick("total"))
            off = F.abs(current - self.baseline_rate)
            return _alert_row(
                self.contract, f"{self.column}_population_rate_shift", F.lit(self.baseline_rate), current,
                _relative_change(current, self.baseline_rate),
                F.when(off > self.tolerance * 2, "high").otherwise("medium"),
                off > self.tolerance, POPULATION_CAUSES, pick("matches"), pick("total"),
            )

        return FusedCheck({"matches": F.count_if(flag), "total": F.count(F.lit(1))}, row)


@dataclass(frozen=True)
class ImplicationProbe:
    """Share of rows with A that also have B does not fall below the baseline."""

    contract: str
    condition_column: str
    condition_value: object
    implication_column: str
    operator: str = ">"
    implication_value: object = None
    baseline_confidence: float = 1.0
    tolerance_drop: float = 0.10

    def _implied(self) -> Column:
        column, value = F.col(self.implication_column), F.lit(self.implication_value)
        operators = {
            ">": column > value,
            "<": column < value,
            ">=": column >= value,
            "<=": column <= value,
            "=": column == value,
            "!=": column != value,
            "IS NOT NULL": column.isNotNull(),
        }
        return operators[self.operator.upper()]

    def check(self) -> FusedCheck:
        condition = F.col(self.condition_column) == F.lit(self.condition_value)
        causes = (
            "Decoupling of business attributes in upstream pipeline",
            f"Definition of '{self.condition_column}' expanded to include records violating implication",
        )

        def row(pick):
            current = rate(pick("matches"), pick("total"))
            drop = self.baseline_confidence - current
            return _alert_row(
                self.contract, f"{self.condition_column}_implies_{self.implication_column}_decay",
                F.lit(self.baseline_confidence), current,
                _relative_change(current, self.baseline_confidence),
                F.when(drop > self.tolerance_drop * 2, "high").otherwise("medium"),
                drop > self.tolerance_drop, causes, pick("matches"), pick("total"),
            )

        return FusedCheck({"matches": F.count_if(condition & self._implied()), "total": F.count_if(condition)}, row)


@dataclass(frozen=True)
class NullDriftProbe:
    """NULL rate of a column stays near its baseline, in both directions."""

    contract: str
    column: str
    baseline_null_rate: float = 0.0
    tolerance: float = 0.02

    def check(self) -> FusedCheck:
        def row(pick):
            current = rate(pick("matches"), pick("total"))
            off = F.abs(current - self.baseline_null_rate)
            return _alert_row(
                self.contract, f"{self.column}_null_rate_shift", F.lit(self.baseline_null_rate), current,
                _relative_change(current, self.baseline_null_rate), F.lit("medium"),
                off > self.tolerance, NULL_CAUSES, pick("matches"), pick("total"),
            )

        return FusedCheck({"matches": F.count_if(F.col(self.column).isNull()), "total": F.count(F.lit(1))}, row)


@dataclass(frozen=True)
class BoundsProbe:
    """Declarative form: the rate of ``predicate`` (among ``given``) lies in [low, high].

    ``given`` turns it into a confidence of an implication; a NULL-rate limit is
    ``predicate="c IS NULL"`` with ``high`` set.
    """

    contract: str
    name: str
    predicate: str
    given: str | None = None
    low: float = 0.0
    high: float = 1.0

    def check(self) -> FusedCheck:
        flag = F.expr(self.predicate)
        base = F.expr(self.given) if self.given else F.lit(True)

        def row(pick):
            current = rate(pick("matches"), pick("total"))
            outside = (current < self.low) | (current > self.high)
            bound = F.when(current < self.low, F.lit(float(self.low))).otherwise(F.lit(float(self.high)))
            return _alert_row(
                self.contract, self.name, bound, current, F.lit(0.0), F.lit("medium"),
                outside, POPULATION_CAUSES, pick("matches"), pick("total"),
            )

        return FusedCheck({"matches": F.count_if(base & flag), "total": F.count_if(base)}, row)


Probe = PopulationProbe | ImplicationProbe | NullDriftProbe | BoundsProbe


def run_probes(df: DataFrame, probes: Sequence[Probe], by: Sequence[str] = ()) -> DataFrame:
    """One row per probe (and slice), alert or not."""
    return run_fused(df, [p.check() for p in probes], by)


def alerts(results: DataFrame) -> DataFrame:
    return results.where("alert")


def probes_from_contract(contract: dict) -> list[Probe]:
    """Probes declared in a contract document, in either of the two grammars."""
    name = contract.get("metric") or contract.get("urn") or "contract"
    declared = contract.get("probes") or {}
    found: list[Probe] = []
    for p in declared.get("population") or ():
        if "predicate" in p:
            found.append(BoundsProbe(name, p.get("name", "population_bounds"), p["predicate"],
                                     low=p.get("min_rate", 0.0), high=p.get("max_rate", 1.0)))
        else:
            found.append(PopulationProbe(name, p["column"], p.get("target_value"), p["baseline_rate"],
                                         p.get("tolerance", 0.05)))
    for p in declared.get("implications") or declared.get("implication") or ():
        if "antecedent" in p:
            found.append(BoundsProbe(name, p.get("name", "implication_bounds"), p["consequent"], p["antecedent"],
                                     low=p.get("min_confidence", 0.0)))
        else:
            found.append(ImplicationProbe(name, p["condition_column"], p["condition_value"], p["implication_column"],
                                          p.get("implication_operator", ">"), p.get("implication_value"),
                                          p["baseline_confidence"], p.get("tolerance_drop", 0.10)))
    for p in declared.get("null_drift") or ():
        if "max_null_rate" in p:
            found.append(BoundsProbe(name, f"{p['column']}_null_bounds", f"{p['column']} IS NULL",
                                     high=p["max_null_rate"]))
        else:
            found.append(NullDriftProbe(name, p["column"], p.get("baseline_null_rate", 0.0),
                                        p.get("tolerance", 0.02)))
    return found
