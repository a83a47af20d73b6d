"""Does a table hold enough contrast to expose mistakes in a metric?

Volume, status, category and numeric checks share one scan.  The grain check
asks whether some key repeats, which is one hash aggregate over the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.fused import FusedCheck, run_fused
from plumbline.operators.joins import key_counts

ADEQUATE_PCT = 70.0
MIN_ROWS = 3

# Columns taken for each role when the caller names none.
STATUS_COLUMNS = ("status",)
CATEGORY_COLUMNS = ("region", "type", "category", "channel")
NUMERIC_COLUMNS = ("amount", "revenue", "price", "cost", "quantity")
KEY_COLUMNS = ("customer_id", "user_id", "order_id", "account_id")


@dataclass(frozen=True)
class Roles:
    """Which columns play which part; missing roles are not checked."""

    status: str | None = None
    categories: tuple[str, ...] = ()
    numeric: str | None = None
    key: str | None = None
    active_value: str = "active"

    @classmethod
    def guess(cls, columns: Sequence[str]) -> Roles:
        def first(names):
            return next((c for c in names if c in columns), None)

        return cls(
            first(STATUS_COLUMNS),
            tuple(c for c in CATEGORY_COLUMNS if c in columns),
            first(NUMERIC_COLUMNS),
            first(KEY_COLUMNS),
        )


def _row(check: str, passed: Column, otherwise: str, observed: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check_name"),
        F.when(passed, "PASS").otherwise(otherwise).alias("status"),
        observed.cast("double").alias("observed"),
    )


def _more_than_one(column: str) -> dict[str, Column]:
    """Two values differ iff min and max do; a NULL next to values counts as a value too."""
    value = F.col(column).cast("string")
    return {"low": F.min(value), "high": F.max(value), "nulls": F.max(value.isNull()), "some": F.max(value.isNotNull())}


def _varied(pick) -> Column:
    return F.coalesce((pick("low") != pick("high")) | (pick("nulls") & pick("some")), F.lit(False))


def volume_check() -> FusedCheck:
    return FusedCheck(
        {"n": F.count(F.lit(1))}, lambda pick: _row("volume", pick("n") >= MIN_ROWS, "WARN", pick("n"))
    )


def status_check(column: str, active_value: str = "active") -> FusedCheck:
    """More than one status, and one of them is not the active one."""
    aggregates = _more_than_one(column)
    aggregates["inactive"] = F.count_if(F.lower(F.col(column)) != active_value.lower())
    return FusedCheck(
        aggregates,
        lambda pick: _row("status", _varied(pick) & (pick("inactive") > 0), "FAIL", pick("inactive")),
    )


def category_check(column: str) -> FusedCheck:
    return FusedCheck(
        _more_than_one(column),
        lambda pick: _row(f"category_{column}", _varied(pick), "WARN", _varied(pick).cast("int")),
    )


def numeric_check(column: str) -> FusedCheck:
    return FusedCheck(
        {"low": F.min(column), "high": F.max(column), "mean": F.avg(column)},
        lambda pick: _row(
            f"numeric_{column}",
            F.coalesce(pick("low") != pick("high"), F.lit(False)),
            "WARN",
            F.round(pick("mean").cast("double"), 2),
        ),
    )


def grain_check(df: DataFrame, column: str) -> DataFrame:
    """Passes if some key is held by more than one row."""
    repeated = key_counts(df, [column]).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    return repeated.select(F.inline(F.array(_row(f"grain_{column}", F.col("repeated") > 0, "WARN", F.col("repeated")))))


def profile_contrast(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """One row per check: check_name, status, observed."""
    roles = roles or Roles.guess(df.columns)
    checks = [volume_check()]
    if roles.status:
        checks.append(status_check(roles.status, roles.active_value))
    checks += [category_check(c) for c in roles.categories]
    if roles.numeric:
        checks.append(numeric_check(roles.numeric))
    result = run_fused(df, checks)
    if roles.key:
        result = result.unionByName(grain_check(df, roles.key))
    return result


def contrast_score(checks: DataFrame) -> DataFrame:
    """Passed checks in percent, and whether the table is adequate."""
    passed = F.count_if(F.col("status") == "PASS")
    return checks.agg(
        F.count(F.lit(1)).alias("checks"),
        passed.alias("passed_checks"),
        F.round(F.try_divide(passed.cast("double"), F.count(F.lit(1)).cast("double")) * 100.0, 1).alias("score_pct"),
    ).withColumn("adequate", F.coalesce(F.col("score_pct") >= ADEQUATE_PCT, F.lit(False)))
