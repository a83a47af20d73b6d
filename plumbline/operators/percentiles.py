"""Exact percentiles with linear interpolation, without a huge group in one task.

A value falls into one of 2 ** 48 cells that keep the order of values: sign, exponent
and the first 35 bits of the mantissa, so a cell holds at most 2 ** 17 doubles wherever
it lies.  The first half of the cell number is counted first, on the map side: a running
count over these at most 2 ** 24 tops tells those that hold the wanted ranks.
Only their values are shuffled; the second half of the number does the same
among them, and the values of one cell are ordered among themselves.  The path is the
same for every size, and every task holds a bounded number of rows.  The input is read twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HALF_BITS = 24
MANTISSA_BITS = 35
LOWEST = -1075  # exponent below the smallest double's
MIDDLE = 2**47  # the cell of zero


def _cell(value: Column) -> Column:
    """Cell number of a double; infinities and NaN are in the outermost cells."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    place = (exponent - LOWEST) * 2**MANTISSA_BITS + F.floor((size / F.pow(F.lit(2.0), exponent) - 1.0) * float(2**MANTISSA_BITS))
    place = F.when(size == 0, 0).when(size == float("inf"), MIDDLE - 2).otherwise(place)
    signed = F.when(value < 0, -place).otherwise(place)
    return (MIDDLE + F.when(F.isnan(value), MIDDLE - 1).otherwise(signed)).cast("bigint")


def _held(rows: DataFrame, keys: Sequence[str], order: str, size: str) -> DataFrame:
    """The rows in which rank ``__k`` falls, counting up from ``__below``; ``__below`` becomes the count before the row."""
    upto = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = rows.withColumn("__upto", F.col("__below") + F.sum(size).over(upto))
    hit = ranked.where((F.col("__upto") > F.col("__k")) & (F.col("__upto") - F.col(size) <= F.col("__k")))
    return hit.withColumn("__below", F.col("__upto") - F.col(size)).drop("__upto", size)


def aggregate_with_percentiles(
    df: DataFrame,
    aggregates: Sequence[Column],
    value: str,
    probabilities: dict[str, float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Aggregates and exact percentiles per group; a group without values has NULL percentiles."""
    counts = df.groupBy(*by).agg(*aggregates)
    found = _percentiles(df.where(F.col(value).isNotNull()), value, probabilities, by)
    if not by:
        one = found.select(F.struct(*probabilities).alias("p")).scalar()
        return counts.select("*", *[one.getField(a).alias(a) for a in probabilities])
    keyed = found.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], *probabilities)
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return counts.join(keyed, same, "left").drop(*[f"__k{i}" for i in range(len(by))])


def exact_percentiles(df: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with one column per entry of ``probabilities``.

    NULL values are ignored; a group without values is absent from the result.
    """
    return _percentiles(df.where(F.col(value).isNotNull()), value, probabilities, by)


def _matching(left: DataFrame, right: DataFrame, names: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Inner join on ``on`` and the group columns ``names``, where NULL is a group like any other."""
    other = right.withColumnsRenamed({n: f"{n}r" for n in [*names, *on]})
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}r"))
    for n in on:
        same = same & (F.col(n) == F.col(f"{n}r"))
    return left.join(other, same).drop(*[f"{n}r" for n in [*names, *on]])


def _percentiles(df: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str]) -> DataFrame:
    names = [f"__g{i}" for i in range(len(by))]
    groups = [F.col(c).alias(n) for c, n in zip(by, names, strict=True)]
    rows = df.select(*groups, F.col(value).cast("double").alias("__v")).withColumn("__cell", _cell(F.col("__v")))
    rows = rows.withColumn("__top", F.shiftright("__cell", HALF_BITS))

    total = F.sum("__size").over(W.partitionBy(*names))
    at = F.array(*[F.lit(float(p)) for p in probabilities.values()])
    ranks = F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(F.floor(p * (F.col("__total") - 1)), F.ceil(p * (F.col("__total") - 1))))))
    upto = W.partitionBy(*names).orderBy("__top").rowsBetween(W.unboundedPreceding, W.currentRow)
    tops = (
        rows.groupBy(*names, "__top")
        .agg(F.count(F.lit(1)).alias("__size"))
        .withColumns({"__total": total, "__upto": F.sum("__size").over(upto)})
        .withColumn("__below", F.col("__upto") - F.col("__size"))
        .withColumn("__ks", F.filter(ranks, lambda k: (k < F.col("__upto")) & (k >= F.col("__below"))))
        .where(F.size("__ks") > 0)
        .select(*names, "__top", "__total", "__below", "__ks")
    )
    # values of the tops that hold a wanted rank, once for each of these ranks
    inside = _matching(rows, tops, names, ["__top"]).groupBy(*names, "__cell", "__v").agg(
        F.count(F.lit(1)).alias("__n"), F.first("__ks").alias("__ks"), F.first("__below").alias("__below"), F.first("__total").alias("__total")
    )
    inside = inside.select(*names, "__cell", "__v", "__n", "__below", "__total", F.explode("__ks").alias("__k"))
    cells = inside.groupBy(*names, "__k", "__cell").agg(F.sum("__n").alias("__size"), F.max("__below").alias("__below"))
    cells = _held(cells, [*names, "__k"], "__cell", "__size")
    found = _held(_matching(inside.drop("__below"), cells, names, ["__k", "__cell"]), [*names, "__k"], "__v", "__n")
    # floor and ceiling rank carry the weights of the interpolation
    solved = found.withColumn("__at", F.col("__v")).groupBy(*names).agg(*[_weighted(p).alias(a) for a, p in probabilities.items()])
    solved = solved if names else solved.where(F.coalesce(*probabilities).isNotNull())
    return solved.select(*[F.col(n).alias(c) for c, n in zip(by, names, strict=True)], *list(probabilities))


def _weighted(p: float) -> Column:
    place = F.lit(float(p)) * (F.col("__total") - 1)
    weight = 1.0 - F.abs(place - F.col("__k"))
    return F.sum(F.when(weight > 0, weight * F.col("__at")))
