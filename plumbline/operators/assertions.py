"""Data tests over any DataFrame.

An assertion is either row-local, and then only contributes aggregates to the
one fused pass of its suite, or needs a shuffle of its own and returns a one-row
frame of the same aggregates.  Result row: suite, name, type, passed, skipped,
violations, observed, reason.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text
from plumbline.operators import filters
from plumbline.operators.aggregates import duplicates
from plumbline.operators.fused import FusedCheck
from plumbline.operators.joins import joined_pairs, orphan_keys

RESULT_SCHEMA = (
    "suite string, name string, type string, passed boolean, skipped boolean, "
    "violations bigint, observed double, reason string"
)

Pick = Callable[[str], Column]


def result_row(
    suite: str,
    name: str,
    kind: str,
    violations: Column,
    observed: Column,
    reason: str,
    skipped: bool = False,
    passed: Column | None = None,
) -> Column:
    """The result struct; the reason is filled in only for a failed check."""
    passed = (violations == 0) if passed is None else passed
    return F.struct(
        F.lit(suite).alias("suite"),
        F.lit(name).alias("name"),
        F.lit(kind).alias("type"),
        passed.alias("passed"),
        F.lit(skipped).alias("skipped"),
        violations.cast("bigint").alias("violations"),
        observed.cast("double").alias("observed"),
        F.when(~passed, F.lit(reason)).alias("reason"),
    )


@dataclass(frozen=True)
class Assertion:
    """Base of all assertions; subclass it for checks of your own.

    Row-local checks implement :meth:`aggregates`, others :meth:`frame`.  Both
    must provide ``violations``; ``observed`` is the number shown to the reader.
    """

    name: str | None = None
    kind = "assertion"
    reason = "check failed"

    @property
    def label(self) -> str:
        return self.name or self.kind

    def needed_columns(self) -> Sequence[str]:
        return ()

    def is_skipped(self, df: DataFrame, tables: Mapping[str, DataFrame]) -> bool:
        """A check whose columns are absent passes and is marked as skipped."""
        return not set(self.needed_columns()) <= set(df.columns)

    def aggregates(self, df: DataFrame) -> dict[str, Column] | None:
        return None

    def frame(self, df: DataFrame, tables: Mapping[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
        """``violations`` and ``observed``, one row or one row per slice of ``by``.

        A slice without findings may be absent.
        """
        raise NotImplementedError

    def row(self, suite: str, pick: Pick) -> Column:
        return result_row(suite, self.label, self.kind, pick("violations"), pick("observed"), self.reason)

    def fused(self, suite: str, df: DataFrame) -> FusedCheck | None:
        aggregates = self.aggregates(df)
        if aggregates is None:
            return None
        return FusedCheck(aggregates, lambda pick: self.row(suite, pick))

    def skipped_check(self, suite: str) -> FusedCheck:
        zero = F.lit(0).cast("bigint")
        return FusedCheck(
            {"n": F.count(F.lit(1))},
            lambda pick: result_row(
                suite, self.label, self.kind, zero, F.lit(None).cast("double"), "", True, F.lit(True)
            ),
        )


@dataclass(frozen=True)
class NotNull(Assertion):
    """No NULL in the columns; violations are rows, observed is the number of NULL cells."""

    columns: tuple[str, ...] = ()
    kind = "not_null"
    reason = "NULL in a required column"

    @property
    def label(self) -> str:
        return self.name or f"not_null_{'_'.join(self.columns)}"

    def needed_columns(self):
        return self.columns

    def aggregates(self, df):
        return {
            "violations": F.count_if(filters.any_null(self.columns)),
            "observed": F.coalesce(F.sum(filters.null_cells(self.columns)), F.lit(0)),
        }


@dataclass(frozen=True)
class Unique(Assertion):
    """No key held by two rows; violations are key groups, observed the surplus rows."""

    columns: tuple[str, ...] = ()
    kind = "unique"
    reason = "key held by more than one row"

    @property
    def label(self) -> str:
        return self.name or f"{self.kind}_{'_'.join(self.columns)}"

    def needed_columns(self):
        return self.columns

    def frame(self, df, tables, by=()):
        return duplicates(df, self.columns, by).select(
            *by, F.col("duplicate_groups").alias("violations"), F.col("duplicate_rows").alias("observed")
        )


@dataclass(frozen=True)
class Grain(Unique):
    """The declared grain identifies each row."""

    kind = "grain"
    reason = "more than one row at the declared grain"


@dataclass(frozen=True)
class RowCount(Assertion):
    min_rows: int = 1
    max_rows: int | None = None
    kind = "row_count"
    reason = "row count outside its bounds"

    def aggregates(self, df):
        return {"observed": F.count(F.lit(1))}

    def row(self, suite, pick):
        n = pick("observed")
        inside = n >= self.min_rows
        if self.max_rows is not None:
            inside = inside & (n <= self.max_rows)
        return result_row(suite, self.label, self.kind, (~inside).cast("int"), n, self.reason)


@dataclass(frozen=True)
class AcceptedRange(Assertion):
    column: str = ""
    min_value: float | None = None
    max_value: float | None = None
    inclusive: bool = True
    kind = "accepted_range"
    reason = "value outside the accepted range"

    @property
    def label(self) -> str:
        return self.name or f"accepted_range_{self.column}"

    def needed_columns(self):
        return (self.column,)

    def aggregates(self, df):
        outside = filters.out_of_range(self.column, self.min_value, self.max_value, self.inclusive)
        return {"violations": F.count_if(outside), "observed": F.count(F.col(self.column))}


@dataclass(frozen=True)
class AcceptedValues(Assertion):
    column: str = ""
    values: tuple = ()
    quote: bool = True
    kind = "accepted_values"
    reason = "value outside the accepted list"

    @property
    def label(self) -> str:
        return self.name or f"accepted_values_{self.column}"

    def needed_columns(self):
        return (self.column,)

    def aggregates(self, df):
        outside = filters.not_accepted(self.column, self.values, self.quote)
        return {"violations": F.count_if(outside), "observed": F.count(F.col(self.column))}


@dataclass(frozen=True)
class NonNegative(Assertion):
    """No negative value in any numeric column of the frame."""

    kind = "non_negative"
    reason = "negative value in a numeric column"

    def aggregates(self, df):
        flags = [
            F.coalesce(F.col(f.name) < 0, F.lit(False))
            for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType)
        ]
        if not flags:
            return {"violations": F.lit(0).cast("bigint"), "observed": F.count(F.lit(1))}
        any_negative = flags[0]
        for flag in flags[1:]:
            any_negative = any_negative | flag
        cells = sum((flag.cast("int") for flag in flags[1:]), flags[0].cast("int"))
        return {"violations": F.count_if(any_negative), "observed": F.coalesce(F.sum(cells), F.lit(0))}


@dataclass(frozen=True)
class MetricValue(Assertion):
    """The column's total meets an expectation within a tolerance, and its bounds."""

    column: str = ""
    expected: float | None = None
    min_value: float | None = None
    max_value: float | None = None
    tolerance_pct: float = 0.01
    kind = "metric_value"
    reason = "total differs from the expected value"

    @property
    def label(self) -> str:
        return self.name or f"metric_value_{self.column}"

    def needed_columns(self):
        return (self.column,)

    def aggregates(self, df):
        return {"observed": F.coalesce(F.sum(F.col(self.column)).cast("double"), F.lit(0.0))}

    def row(self, suite, pick):
        total = pick("observed")
        fine = F.lit(True)
        if self.expected is not None:
            allowed = abs(self.expected * self.tolerance_pct / 100.0) if self.expected != 0 else 0.001
            fine = fine & (F.abs(total - self.expected) <= allowed)
        if self.min_value is not None:
            fine = fine & (total >= self.min_value)
        if self.max_value is not None:
            fine = fine & (total <= self.max_value)
        return result_row(suite, self.label, self.kind, (~fine).cast("int"), total, self.reason)


@dataclass(frozen=True)
class Relationships(Assertion):
    """Every non-NULL child key exists in the parent; skipped if the parent is not given."""

    from_column: str = ""
    to_table: str = ""
    to_column: str = ""
    kind = "relationships"
    reason = "child key without a parent"

    @property
    def label(self) -> str:
        return self.name or f"relationships_{self.from_column}_to_{self.to_table}_{self.to_column}"

    def needed_columns(self):
        return (self.from_column,)

    def is_skipped(self, df, tables):
        return self.to_table not in tables or super().is_skipped(df, tables)

    def frame(self, df, tables, by=()):
        orphans = orphan_keys(df, self.from_column, tables[self.to_table], self.to_column, by)
        return orphans.groupBy(*by).agg(
            F.coalesce(F.sum("child_rows"), F.lit(0)).alias("violations"),
            F.count(F.lit(1)).alias("observed"),
        )


@dataclass(frozen=True)
class Singular(Assertion):
    """User SQL over ``{{ model }}``; every returned row is a violation.

    Tables passed to the suite are written ``{{ name }}`` as well; other names
    are looked up in the catalog.
    """

    sql: str = ""
    kind = "singular_sql_test"
    reason = "the singular test returned rows"

    def frame(self, df, tables, by=()):
        if by:
            raise ValueError("a singular test has no slices; run it per slice")
        spark = df.sparkSession
        query, views = self.sql, []
        for given, frame in {**tables, "model": df}.items():
            marker = re.compile(r"\{\{\s*" + re.escape(given) + r"\s*\}\}")
            if marker.search(query):
                view = f"singular_{uuid.uuid4().hex[:12]}"
                frame.createOrReplaceTempView(view)
                views.append(view)
                query = marker.sub(view, query)
        counted = spark.sql(query).agg(F.count(F.lit(1)).alias("violations"))
        # the analysed plan holds the frames from here on
        for view in views:
            spark.catalog.dropTempView(view)
        return counted.withColumn("observed", F.col("violations"))


@dataclass(frozen=True)
class Population(Assertion):
    """No source row that breaks the required filter may reach the output.

    Violations count joined pairs, observed counts entities.  Only violating
    source rows are shuffled, and both sides are counted per key first.
    """

    source_table: str = "transactions"
    required_filter: str = "1=1"
    join_key: str = "customer_id"
    kind = "population"
    reason = "rows outside the required population reach the output"

    @property
    def label(self) -> str:
        return self.name or f"population_{text.normalise_predicate_text(self.required_filter)}"

    def needed_columns(self):
        return (self.join_key,)

    def is_skipped(self, df, tables):
        return self.source_table not in tables or super().is_skipped(df, tables)

    def frame(self, df, tables, by=()):
        breaking = filters.breaking(tables[self.source_table], self.required_filter)
        return joined_pairs(df, breaking, self.join_key, by=by).select(
            *by, F.least("pairs", F.lit(2**63 - 1).cast("decimal(38,0)")).cast("bigint").alias("violations"), F.col("entities").alias("observed")
        )


@dataclass(frozen=True)
class Custom(Assertion):
    """Any callable that maps the frame to violating rows."""

    violating: Callable[[DataFrame], DataFrame] = field(default=lambda df: df.limit(0))
    kind = "custom"
    reason = "the custom check returned rows"

    def frame(self, df, tables, by=()):
        return self.violating(df).groupBy(*by).agg(
            F.count(F.lit(1)).alias("violations"), F.count(F.lit(1)).alias("observed")
        )
