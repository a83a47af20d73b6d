"""Comparing two results.

Both sides are stacked and aggregated by row or by key with a sign, so equal
rows cancel on the map side and one shuffle decides the question.  Neither side
is sorted and no row pairs are built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 4  # numbers are compared at this many decimals
EQUAL_PCT = 0.001  # totals closer than this are taken as equal


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _canonical(field: T.StructField, digits: int | None) -> Column:
    """Comparable form: integers and decimals as they are, floating numbers rounded to ``digits``."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        number = value.cast("double")
        # adding 0.0 turns -0.0 into 0.0
        return (F.round(number, digits) if digits is not None else number) + F.lit(0.0)
    if isinstance(field.dataType, T.NumericType):
        return value
    if isinstance(field.dataType, T.StringType):
        return F.trim(value) if digits is not None else value
    return value.cast("string")


def _common_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """The type in which two columns are compared: the wider one, text where there is none."""
    if left == right:
        return left
    if not (isinstance(left, T.NumericType) and isinstance(right, T.NumericType)):
        return T.StringType()
    if any(isinstance(x, (T.FloatType, T.DoubleType)) for x in (left, right)):
        return T.DoubleType()
    scale = max(x.scale if isinstance(x, T.DecimalType) else 0 for x in (left, right))
    return T.DecimalType(38, scale) if any(isinstance(x, T.DecimalType) for x in (left, right)) else T.LongType()


def _aligned(base: DataFrame, other: DataFrame, digits: int | None) -> tuple[DataFrame, DataFrame] | None:
    """Both sides with the same column names, or None if their widths differ."""
    if len(base.columns) != len(other.columns):
        return None
    names = sorted(base.columns)
    by_name = names == sorted(other.columns)

    def project(df):
        fields = [df.schema[n] for n in names] if by_name else df.schema.fields
        return df.select(*[_canonical(f, digits).alias(f"c{i}") for i, f in enumerate(fields)])

    left, right = project(base), project(other)
    wide = [_common_type(a.dataType, b.dataType) for a, b in zip(left.schema.fields, right.schema.fields, strict=True)]
    return tuple(df.select(*[F.col(n).cast(w).alias(n) for n, w in zip(df.columns, wide, strict=True)]) for df in (left, right))


def multiset_difference(base: DataFrame, other: DataFrame, digits: int | None = DIGITS) -> DataFrame:
    """One row: do both hold the same rows the same number of times, and how many differ.

    With ``digits=None`` values are compared exactly.
    """
    aligned = _aligned(base, other, digits)
    if aligned is None:
        return base.agg(F.count(F.lit(1)).alias("only_base")).select(
            "only_base",
            other.agg(F.count(F.lit(1)).alias("n")).scalar().alias("only_other"),
            F.lit(False).alias("equal"),
        )
    left, right = aligned
    stacked = left.withColumn("__sign", F.lit(1)).unionByName(right.withColumn("__sign", F.lit(-1)))
    net = stacked.groupBy(*left.columns).agg(F.sum("__sign").alias("net"))
    return net.agg(
        F.coalesce(F.sum(F.greatest(F.col("net"), F.lit(0))), F.lit(0)).cast("bigint").alias("only_base"),
        F.coalesce(F.sum(F.greatest(-F.col("net"), F.lit(0))), F.lit(0)).cast("bigint").alias("only_other"),
    ).withColumn("equal", (F.col("only_base") == 0) & (F.col("only_other") == 0))


def strict_difference(base: DataFrame, other: DataFrame) -> DataFrame:
    """Exact multiset comparison: no rounding, no trimming."""
    return multiset_difference(base, other, digits=None)


def _totals(df: DataFrame, side: str) -> DataFrame:
    total = F.lit(0.0)
    for column in numeric_columns(df):
        total = total + F.coalesce(F.sum(F.col(f"`{column}`").cast("double")), F.lit(0.0))
    return df.agg(
        F.lit(side).alias("side"), F.count(F.lit(1)).alias("rows"), total.cast("double").alias("total")
    )


def variance(base: DataFrame, other: DataFrame) -> DataFrame:
    """One row: row delta and change in percent.

    For results of the same shape the change is that of the sum of all numeric
    columns; results without numbers are compared row by row.  For other shapes
    it is the row delta.  Permuted values stay unseen here; ``cellwise`` sees them.
    """
    both = _totals(base, "base").unionByName(_totals(other, "other"))
    one = both.agg(
        *[
            F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}")
            for side in ("base", "other")
            for c in ("rows", "total")
        ]
    )
    old, new = F.col("base_total"), F.col("other_total")
    if base.columns != other.columns:
        same_shape, by_value = F.lit(False), F.lit(None).cast("double")
    else:
        same_shape = F.col("base_rows") == F.col("other_rows")
        if numeric_columns(base):
            by_value = F.when(old != 0, F.abs(new - old) / F.abs(old) * 100.0).otherwise(
                F.when(new == 0, F.lit(0.0)).otherwise(F.lit(100.0))
            )
        else:
            equal = strict_difference(base, other).select("equal").scalar()
            by_value = F.when(equal, F.lit(0.0)).otherwise(F.lit(100.0))
    delta = F.col("other_rows") - F.col("base_rows")
    by_rows = F.abs(delta) / F.greatest(F.col("base_rows"), F.lit(1)) * 100.0
    change = F.when(same_shape, by_value).otherwise(by_rows)
    return one.select(
        "base_rows",
        "other_rows",
        delta.alias("row_delta"),
        F.round(change, DIGITS).alias("variance_pct"),
        (same_shape & (change < EQUAL_PCT)).alias("equal"),
    )


def cellwise(base: DataFrame, other: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per grain key: added, removed, changed or same, with both values of each measure.

    Keys are matched with NULL equal to NULL.  A key that a side holds more than once
    is reported as repeated, with the rows of each side; its values are the largest.
    """
    left, right = base.select(*keys, *values), other.select(*keys, *values)

    def side(df, flag):
        shown = []
        for v in values:
            wide = _common_type(left.schema[v].dataType, right.schema[v].dataType)
            number = F.col(v).cast(wide)
            shown.append((F.round(number, DIGITS) + F.lit(0.0) if isinstance(wide, T.DoubleType) else number).alias(v))
        return df.select(*keys, F.lit(flag).alias("__base"), *shown)

    stacked = side(left, True).unionByName(side(right, False))
    picked = []
    for v in values:
        picked.append(F.max(F.when(F.col("__base"), F.col(v))).alias(f"{v}_base"))
        picked.append(F.max(F.when(~F.col("__base"), F.col(v))).alias(f"{v}_other"))
    merged = stacked.groupBy(*keys).agg(F.count_if("__base").alias("rows_base"), F.count_if(~F.col("__base")).alias("rows_other"), *picked)
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"{v}_base").eqNullSafe(F.col(f"{v}_other"))
    change = (
        F.when((F.col("rows_base") > 1) | (F.col("rows_other") > 1), "repeated")
        .when(F.col("rows_base") == 0, "added")
        .when(F.col("rows_other") == 0, "removed")
        .when(same, "same")
        .otherwise("changed")
    )
    return merged.withColumn("change", change)


#: Bits of a bucket number on the two levels of the tree, and of one word of a row's hashes.
COARSE_BITS, FINE_BITS = 12, 20
WORD_BITS = 24


def _bucketed(df: DataFrame, placing: Sequence[Column], cells: Sequence[Column]) -> DataFrame:
    """The rows with a hash of the placing cells and the words of two hashes of all cells."""

    def hashed(columns, seed):
        # a hash passes over NULL, so every cell comes with its own null mark
        return F.xxhash64(F.lit(seed), *[part for c in columns for part in (c, c.isNull())])

    words = {
        f"__w{i}{j}": F.shiftright(hashed(cells, i), WORD_BITS * j).bitwiseAND(F.lit((1 << WORD_BITS) - 1)) for i in range(2) for j in range(2)
    }
    return df.withColumns({"__key": hashed(placing, 2), **words})


def _bucket(bits: int) -> Column:
    return F.shiftrightunsigned("__key", 64 - bits)


def _unequal(left: DataFrame, right: DataFrame, bits: int) -> DataFrame:
    """Numbers of the buckets (leading bits of the key hash) whose rows differ.

    Word sums and counts cancel where both sides hold the same rows.  A task sends one row per
    bucket, whatever it has read.  The sums hold 2^39 rows of a bucket; different rows pass
    for equal with a chance of 2^-96.
    """
    words = [c for c in left.columns if c.startswith("__w")]
    one = left.select(_bucket(bits).alias("bucket"), *words, F.lit(1).cast("bigint").alias("__one"))
    other = right.select(_bucket(bits).alias("bucket"), *[(-F.col(w)).alias(w) for w in words], F.lit(-1).cast("bigint").alias("__one"))
    sums = one.unionByName(other).groupBy("bucket").agg(*[F.sum(w).alias(w) for w in [*words, "__one"]])
    return sums.where(" OR ".join(f"{w} <> 0" for w in [*words, "__one"])).select("bucket")


def _unequal_part(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of both bucketed sides in fine buckets that differ; only bucket sums are shuffled.

    Broadcast are at most 2^COARSE_BITS and 2^FINE_BITS bucket numbers.
    """
    sides = (left, right)
    for bits in (COARSE_BITS, FINE_BITS):
        differing = F.broadcast(_unequal(*sides, bits))
        # each level filters the tables as they are, a fine bucket implies its coarse one
        sides = tuple(df.join(differing, _bucket(bits) == F.col("bucket"), "left_semi") for df in (left, right))
    return sides


def tree_difference(base: DataFrame, other: DataFrame, digits: int | None = DIGITS) -> DataFrame:
    """``multiset_difference`` for two large tables that should be equal or nearly so.

    Bucket fingerprints are compared first, and only rows of buckets that differ are
    shuffled; equal tables shuffle fingerprints alone.  Each side is read up to three times.
    """
    aligned = _aligned(base, other, digits)
    if aligned is None:
        return multiset_difference(base, other, digits)
    left, right = (_bucketed(df, [F.col(c) for c in df.columns], [F.col(c) for c in df.columns]) for df in aligned)
    # the cells are canonical already
    return multiset_difference(*[df.select(*aligned[0].columns) for df in _unequal_part(left, right)], digits=None)


def tree_cellwise(base: DataFrame, other: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The rows of ``cellwise`` whose change is not ``same``, from buckets of keys that differ.

    A key that both sides hold more than once, with the same rows, is no difference here.
    """
    sides = [df.select(*keys, *values) for df in (base, other)]
    wide = {c: _common_type(sides[0].schema[c].dataType, sides[1].schema[c].dataType) for c in (*keys, *values)}

    def cell(name):
        value = F.col(f"`{name}`").cast(wide[name])
        if isinstance(wide[name], T.DoubleType):
            return (F.round(value, DIGITS) if name in values else value) + F.lit(0.0)
        return value + F.lit(0.0).cast("float") if isinstance(wide[name], T.FloatType) else value

    parts = _unequal_part(*[_bucketed(df, [cell(k) for k in keys], [cell(c) for c in (*keys, *values)]) for df in sides])
    # what is left is small: keys that differ are told from their neighbours in the bucket
    differing = _unequal(*parts, 64)
    rows = [df.join(differing, F.col("__key") == F.col("bucket"), "left_semi").select(*keys, *values) for df in parts]
    return cellwise(*rows, keys, values).where("change <> 'same'")


def fingerprint(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """One row: content hash that depends neither on row order nor on partitioning.

    The sha256 of each canonical row is cut into four 32-bit words, which are
    summed over the rows (as decimals, which no row count overflows); the sums and
    the row count are hashed again.
    """
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    texts = [_canonical(f, digits).cast("string") for f in fields]
    # each cell after its own length, so no text can pass for two cells or for NULL
    cells = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in texts]
    hashed = df.select(F.sha2(F.concat(*cells), 256).alias("h"))
    words = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    summed = hashed.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.coalesce(F.sum(w.cast("decimal(18,0)")), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"w{i}") for i, w in enumerate(words)],
    )
    return summed.select(
        "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), "w0", "w1", "w2", "w3"), 256).alias("fingerprint")
    )
