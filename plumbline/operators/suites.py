"""Suites: named lists of assertions, run with as few scans as their shuffles allow."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import assertions as A
from plumbline.operators.fused import run_fused
from plumbline.session import stored

# Names under which each test type may be declared.
TYPE_ALIASES = {
    "not_null": ("not_null", "non_null"),
    "unique": ("unique", "unique_key"),
    "row_count": ("row_count", "row_count_bounds"),
    "accepted_range": ("accepted_range", "range", "dbt_utils.accepted_range"),
    "accepted_values": ("accepted_values", "categorical_set", "domain"),
    "relationships": ("relationships", "foreign_key", "referential_integrity"),
    "singular_sql_test": ("singular_sql_test", "singular_test", "singular_sql", "custom_sql"),
    "population": ("population", "required_population", "required_filter"),
    "metric_value": ("metric_value", "expected_value"),
    "grain": ("grain", "expected_grain"),
    "non_negative": ("non_negative",),
}

CANONICAL_TYPE = {alias: kind for kind, aliases in TYPE_ALIASES.items() for alias in aliases}


DECLARABLE = {cls.kind: cls for cls in (A.NotNull, A.Unique, A.RowCount, A.AcceptedRange, A.AcceptedValues, A.Relationships, A.Singular, A.Population, A.MetricValue, A.Grain, A.NonNegative)}

# Other names for an assertion's fields, first the preferred one, and values for fields that are not declared.
FIELD_NAMES = {
    ("grain", "columns"): ("columns", "grain_columns"),
    ("relationships", "from_column"): ("from_column", "column"),
    ("relationships", "to_column"): ("to_column", "field"),
    ("population", "required_filter"): ("expression", "required_filter"),
    ("metric_value", "expected"): ("expected", "expected_value"),
}
FIELD_DEFAULTS = {("singular_sql_test", "name"): "singular_sql_test", ("metric_value", "column"): "net_revenue"}


def assertion_from_dict(conf: Mapping) -> A.Assertion | None:
    """The declared assertion, or None for a type that is not supported.

    An assertion class takes its own fields, under their names or those of
    ``FIELD_NAMES``; 0 and empty text count as declared, None does not.
    """
    kind = CANONICAL_TYPE.get(str(conf.get("type", "")).lower())
    if kind is None:
        return None
    given = {}
    for own in fields(DECLARABLE[kind]):
        place = (kind, own.name)
        value = next((conf[n] for n in FIELD_NAMES.get(place, (own.name,)) if conf.get(n) is not None), FIELD_DEFAULTS.get(place))
        if value is not None:
            given[own.name] = tuple(value) if isinstance(own.default, tuple) else value
    return DECLARABLE[kind](**given)


@dataclass
class Suite:
    name: str
    assertions: list[A.Assertion] = field(default_factory=list)

    def add(self, assertion: A.Assertion) -> Suite:
        self.assertions.append(assertion)
        return self

    @classmethod
    def from_dict(cls, conf: Mapping) -> Suite:
        found = (assertion_from_dict(c) for c in conf.get("assertions", ()))
        return cls(conf.get("suite_name", "suite"), [a for a in found if a is not None])

    @classmethod
    def from_yaml_text(cls, content: str) -> Suite:
        import yaml

        return cls.from_dict(yaml.safe_load(content) or {})


def structural_suite() -> Suite:
    """Default tier-1 suite of the net revenue model."""
    return Suite(
        "structural",
        [
            A.NotNull(columns=("customer_id", "reporting_month", "net_revenue")),
            A.Unique(columns=("customer_id", "reporting_month")),
            A.RowCount(min_rows=1),
        ],
    )


def project_suite() -> Suite:
    """Default tier-2 suite: what a shop project usually declares."""
    return Suite(
        "project",
        [
            A.NotNull(columns=("order_id", "customer_id", "amount")),
            A.Unique(columns=("order_id",)),
            A.RowCount(min_rows=1),
            A.AcceptedRange(column="amount", min_value=0.0),
            A.AcceptedValues(
                column="status", values=("placed", "shipped", "completed", "return_pending", "returned")
            ),
            A.Relationships(from_column="customer_id", to_table="customers", to_column="customer_id"),
            A.Singular(
                name="assert_positive_total_for_payments",
                sql="SELECT order_id FROM {{ model }} GROUP BY order_id HAVING NOT (SUM(amount) >= 0)",
            ),
        ],
    )


def semantic_suite() -> Suite:
    """Default semantic suite of the net revenue model: population, grain and value."""
    return Suite(
        "semantic",
        [
            A.NotNull(columns=("customer_id", "reporting_month", "net_revenue")),
            A.Grain(columns=("customer_id", "reporting_month")),
            A.Population(source_table="transactions", required_filter="status = 'active'", join_key="customer_id"),
            A.Population(source_table="transactions", required_filter="region = 'NA'", join_key="customer_id"),
            A.MetricValue(column="net_revenue", expected=3000.0, tolerance_pct=5.0),
        ],
    )


def run_suite(
    df: DataFrame,
    suite: Suite,
    tables: Mapping[str, DataFrame] | None = None,
    by: Sequence[str] = (),
    store: bool = False,
) -> DataFrame:
    """One result row per assertion, or per assertion and slice of ``by``.

    All row-local assertions share one aggregate; each of the others adds its own
    shuffle.  Assertions that cannot run on this frame pass and are marked skipped.
    ``store`` writes the frame to the shared folder first: worth it for a computed
    result under several shuffling assertions, a waste for a plain table.
    Slices are those found in ``df``; an assertion with a shuffle of its own may
    have no row for a slice it has no finding for.
    """
    tables = dict(tables or {})
    if store:
        df = stored(df, f"suite-{suite.name}")
    fused, frames = [], []
    for assertion in suite.assertions:
        if assertion.is_skipped(df, tables):
            fused.append(assertion.skipped_check(suite.name))
            continue
        check = assertion.fused(suite.name, df)
        if check is not None:
            fused.append(check)
        else:
            result = assertion.frame(df, tables, by)
            frames.append(result.select(*by, F.inline(F.array(assertion.row(suite.name, F.col)))))
    if fused:
        frames.insert(0, run_fused(df, fused, by))
    return reduce(DataFrame.unionByName, frames)


def suite_verdict(results: DataFrame) -> DataFrame:
    """Per suite: did everything pass, did anything fail, and which checks failed."""
    failed = F.when(~F.col("passed"), F.col("name"))
    return results.groupBy("suite").agg(
        F.bool_and("passed").alias("all_passed"),
        F.bool_or(~F.col("passed")).alias("any_failed"),
        F.count_if(~F.col("passed")).alias("failed"),
        # as many names as the suite has assertions
        F.array_sort(F.collect_set(failed)).alias("assertions_failed"),
    )


# --- tests declared in a project's schema files, one row per declared test -------------------

SUPPORTED_SCHEMA_TESTS = (
    "not_null",
    "unique",
    "accepted_values",
    "accepted_range",
    "dbt_utils.accepted_range",
    "relationships",
    "dbt_utils.unique_combination_of_columns",
    "row_count_bounds",
    "dbt_utils.row_count_bounds",
)


def classify_schema_tests(tests: DataFrame) -> DataFrame:
    """Per model: declared, supported and skipped tests, with the skipped names.

    Input columns: model, column_name (NULL for a test of the model), test.
    """
    supported = F.lower("test").isin(*SUPPORTED_SCHEMA_TESTS)
    label = F.concat_ws(".", F.coalesce("column_name", F.lit("model_test")), "test")
    return tests.groupBy("model").agg(
        F.count(F.lit(1)).alias("declared_tests"),
        F.count_if(supported).alias("supported_tests"),
        F.count_if(~supported).alias("skipped_tests"),
        F.array_sort(F.collect_set(F.when(~supported, label))).alias("skipped_names"),
    )


def suite_from_schema_tests(model: str, declared: Iterable[Mapping]) -> Suite:
    """Assertions for the supported declarations (column, test, arguments) of one model."""
    suite = Suite(f"schema_tests_{model}")
    for entry in declared:
        test = str(entry["test"]).lower()
        column, args = entry.get("column"), dict(entry.get("args") or {})
        if test not in SUPPORTED_SCHEMA_TESTS:
            continue
        if test in ("not_null", "unique"):
            conf = {"type": test, "columns": [column]}
        elif test.endswith("unique_combination_of_columns"):
            conf = {"type": "unique", "columns": args.get("combination_of_columns", [])}
        elif test.endswith("row_count_bounds"):
            conf = {"type": "row_count", **args}
        elif test == "relationships":
            target = str(args.get("to", args.get("to_table", "")))
            if target.startswith("ref("):
                target = target[4:].rstrip(")").strip("'\"")
            conf = {
                "type": "relationships",
                "column": column,
                "to_table": target,
                "to_column": args.get("field", args.get("to_column", "")),
            }
        else:
            conf = {"type": test, "column": column, **args}
        suite.add(assertion_from_dict(conf))
    if not suite.assertions:
        suite.add(A.RowCount("table_exists", 1))
    return suite
