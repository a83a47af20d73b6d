"""Aggregations of the inventory that are more than one built-in call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import rate
from plumbline.operators.joins import key_counts


def conditional_rate(df: DataFrame, predicate: str) -> DataFrame:
    """Matching rows, all rows and their rate, in one pass."""
    counts = df.agg(
        F.count_if(F.expr(predicate)).alias("matches"),
        F.count(F.lit(1)).alias("total"),
    )
    return counts.withColumn("rate", rate(F.col("matches"), F.col("total")))


def duplicates(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Key groups held by more than one row, and the rows beyond the first.

    NULL keys count as equal, as in GROUP BY.
    """
    return (
        key_counts(df, [*by, *keys])
        .groupBy(*by)
        .agg(
            F.count_if(F.col("n") > 1).alias("duplicate_groups"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
        )
    )


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of distinct values per column; NULL counts as one value."""
    counts = df.agg(
        *[
            (F.count_distinct(F.col(c)) + F.coalesce(F.max(F.col(c).isNull().cast("bigint")), F.lit(0))).alias(c)
            for c in columns
        ]
    )
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("distinct_values")) for c in columns]
    return counts.select(F.inline(F.array(*rows)))


def category_shares(df: DataFrame, column: str, digits: int = 1) -> DataFrame:
    """Count and percentage of each category."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return key_counts(df, [column], "rows").withColumn(
        "share_pct", F.round(F.col("rows") / total.cast("double") * 100.0, digits)
    )
