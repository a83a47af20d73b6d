"""Joins of the reliability jobs.

No side is broadcast by hint: Spark broadcasts what its statistics show to be
below ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges the rest, with
skewed partitions split by adaptive execution.  Where only counts are wanted,
both sides are counted per key first, so a hot key is one row before it moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_counts(df: DataFrame, keys: Sequence[str], alias: str = "n") -> DataFrame:
    """Rows per key; combined on the map side, so hot keys shuffle as one row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))


def orphan_keys(
    child: DataFrame, from_column: str, parent: DataFrame, to_column: str, by: Sequence[str] = ()
) -> DataFrame:
    """Child keys without a parent, with their row counts; NULL child keys are no orphans.

    Child and parent keys are stacked and counted by key.  An anti join would be
    moved below the count by the optimizer and drag the rows of a hot key along.
    """
    rows = child.where(F.col(from_column).isNotNull()).select(*by, F.col(from_column).alias("key"))
    counted = key_counts(rows, [*by, "key"], "child_rows")
    if by:
        # the slices of a key are few; they meet the parent keys once they are counted
        return counted.join(parent.select(F.col(to_column).alias("key")).distinct(), "key", "left_anti")
    parents = parent.where(F.col(to_column).isNotNull()).select(F.col(to_column).alias("key"))
    stacked = rows.withColumn("n", F.lit(1)).unionByName(parents.withColumn("n", F.lit(0)))
    met = stacked.groupBy("key").agg(F.sum("n").alias("child_rows"), F.min("n").alias("lowest"))
    return met.where(F.col("lowest") == 1).select("key", "child_rows")


#: Row counts as decimals: the product of two sides of a hot key leaves the range of a bigint.
_COUNT = "decimal(19,0)"


def joined_pairs(
    left: DataFrame, right: DataFrame, key: str, right_key: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Number of joined row pairs and of shared keys, without building the pairs."""
    lefts = key_counts(left.select(*by, F.col(key).alias("key")).where("key IS NOT NULL"), [*by, "key"], "n_left")
    rights = key_counts(
        right.select(F.col(right_key or key).alias("key")).where("key IS NOT NULL"), ["key"], "n_right"
    )
    return (
        lefts.join(rights, "key")
        .groupBy(*by)
        .agg(
            F.coalesce(F.sum(F.col("n_left").cast(_COUNT) * F.col("n_right").cast(_COUNT)), F.lit(0)).cast("decimal(38,0)").alias("pairs"),
            F.count(F.lit(1)).alias("entities"),
        )
    )


def lookup(rows: DataFrame, dimension: DataFrame, on: Sequence[str] | str, required: bool = True) -> DataFrame:
    """Attach a dimension whose key is unique; unmatched rows are dropped or kept with NULLs."""
    return rows.join(dimension, on, "inner" if required else "left")


def fanout_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row count of a join that lost its condition, from the two counts alone."""
    n_right = right.agg(F.count(F.lit(1)).alias("n")).scalar()
    return left.agg((F.count(F.lit(1)).cast(_COUNT) * n_right.cast(_COUNT)).cast("decimal(38,0)").alias("joined_rows"))
