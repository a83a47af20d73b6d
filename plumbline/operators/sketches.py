"""Stored sketches that merge: distinct counts and percentiles of any span of days without reading rows.

A day's rows become one row of sketches per slice, kept as a table partitioned by day.  Months
or slices are merged from those rows; a day that came late or was corrected replaces its
partition alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of the sketches, and the errors that follow from it: relative standard error of a
#: distinct count, 1.04 / sqrt(2^14), and rank error of a percentile at 99 % confidence.
DISTINCT_LG_K = 14
DISTINCT_ERROR = 0.0082
QUANTILE_K = 1000
QUANTILE_ERROR = 0.005


def daily_sketches(df: DataFrame, day: Column, dims: Sequence[str] = (), distinct: Mapping[str, Column] | None = None, values: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per day and slice: rows, a distinct-count sketch and a quantile sketch per name.

    NULL is no value of either; NaN is none of a quantile sketch.  Sketches are built in the
    tasks that read and merged after, so a hot slice moves one sketch per task.
    """
    columns = [F.hll_sketch_agg(c, DISTINCT_LG_K).alias(f"distinct_{n}") for n, c in (distinct or {}).items()]
    for name, column in (values or {}).items():
        number = column.cast("double")
        columns.append(F.kll_sketch_agg_double(F.when(~F.isnan(number), number), QUANTILE_K).alias(f"values_{name}"))
    return df.groupBy(day.cast("date").alias("day"), *dims).agg(F.count(F.lit(1)).alias("rows"), *columns)


def store_days(sketches: DataFrame, path: str) -> None:
    """Writes the days of ``sketches`` below ``path``; days that are there already are replaced, others stay."""
    sketches.write.partitionBy("day").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(sketches: DataFrame, by: Sequence[str | Column] = (), quantiles: Mapping[str, float] | None = None) -> DataFrame:
    """Estimates per ``by``, from rows of sketches: ``rows``, ``distinct_*``, and ``values_*_p`` for each named quantile.

    A quantile of no values is NULL.
    """
    distinct = [c for c in sketches.columns if c.startswith("distinct_")]
    values = [c for c in sketches.columns if c.startswith("values_")]
    whole = sketches.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in distinct],
        *[F.kll_merge_agg_double(c).alias(c) for c in values],
    )
    shown = {
        f"{c}_{name}": F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(rank)))
        for c in values
        for name, rank in (quantiles or {}).items()
    }
    return whole.withColumns(shown).drop(*values) if shown else whole.drop(*values)
