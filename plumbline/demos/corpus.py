"""A corpus of metrics on the driver's tables, its kill matrix, and replay of traces on snapshots.

The expressions are written so that the metrics' text runs in DuckDB as well: the SQL
below runs every variant's own text, so it also shows that the catalogue says what the
specs compute.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.operators import assertions as A
from plumbline.operators import scoring
from plumbline.operators.suites import Suite
from plumbline.plans.catalogue import aggregate_calls, catalogue, describe, metric_text
from plumbline.plans.spec import Measure, MetricSpec, Predicate, Ratio, Term
from plumbline.plans.variants import BASE, edits
from plumbline.session import path_exists, scratch_path
from plumbline.sources.tables import read_table as t


def _metric(name, dims, measures, *filters):
    return MetricSpec(name, tuple(dims), tuple(measures), tuple(Predicate(*f) for f in filters))


#: name -> (spec, source table)
METRICS = {
    spec.name: (spec, table)
    for spec, table in (
        (
            _metric(
                "net_revenue",
                (("supplier", "l_suppkey"), ("ship_year", "year(l_shipdate)")),
                (Measure("revenue", (Term("l_extendedprice", when="l_returnflag <> 'R'"), Term("l_extendedprice", when="l_returnflag = 'R'", sign=-1))),),
                ("l_quantity", ">", "5"),
                ("l_linestatus", "=", "'O'"),
            ),
            "lineitem",
        ),
        (_metric("order_value", (("customer", "o_custkey"),), (Measure("order_value", (Term("o_totalprice", agg="avg"),)),), ("o_totalprice", ">", "60000"), ("o_orderstatus", "=", "'F'")), "orders"),
        (_metric("active_users", (("kind", "event_type"),), (Measure("users", (Term("user_id", agg="count", distinct=True),)),), ("value", ">", "10"), ("user_id", "<>", "3")), "events"),
        (_metric("discount_rate", (("flag", "l_returnflag"), ("line", "l_linenumber")), (Ratio("rate", Term("l_discount * l_extendedprice"), Term("l_extendedprice")),), ("l_linestatus", "=", "'F'")), "lineitem"),
        (_metric("open_balance", (("nation", "c_nationkey"),), (Measure("balance", (Term("nullif(c_acctbal, abs(c_acctbal))", agg="avg", default=0.0),)),), ("c_mktsegment", "<>", "'BUILDING'")), "customer"),
        (_metric("supplier_count", (("nation", "s_nationkey"),), (Measure("suppliers", (Term("s_suppkey", agg="count"),)),), ("s_acctbal", ">", "0")), "supplier"),
        (_metric("part_price", (("size", "p_size"),), (Measure("price", (Term("p_retailprice", agg="avg"),)),), ("p_size", ">", "10")), "part"),
        (_metric("order_states", (("priority", "o_orderpriority"),), (Measure("states", (Term("o_orderstatus", agg="count", distinct=True),)),), ("o_totalprice", ">", "0")), "orders"),
        (_metric("text_length", (("lang", "lang"), ("source", "source")), (Measure("chars", (Term("n_chars"), Term("1", agg="count", sign=-1))),), ("n_chars", ">", "-1")), "documents"),
        (_metric("line_tax", (("line", "l_linenumber"),), (Measure("tax", (Term("l_tax", agg="avg"),)),)), "lineitem"),
    )
}

#: The faults of the corpus that Spark cannot plan: a sum over text.
UNPLANNABLE = {("order_states", "AGGREGATION_SWAP")}

#: metric, description, owner, grain, version, family, required filters, required dimensions, required function; order_states has none, line_tax no owner.
CONTRACTS = [
    ("net_revenue", "Revenue less returns", "finance", "supplier and year", "2.0.0", "sales", ["l_quantity > 5", "l_linestatus = 'O'"], ["year(l_shipdate)"], None),
    ("order_value", None, "sales", "customer", "1.2.0", "orders", ["o_orderstatus = 'F'"], ["o_custkey"], "avg"),
    ("active_users", "Users with an event of note", "product", "event type", "1.0.0", "product_usage", ["value > 10"], ["event_type"], None),
    ("discount_rate", "Discount over list price", "finance", "flag and line", "1.0.1", "pricing", ["l_linestatus = 'F'"], ["l_linenumber"], "sum"),
    ("open_balance", None, "risk", "nation", "3.0.0", "credit", ["c_mktsegment <> 'BUILDING'"], [], None),
    ("supplier_count", "Suppliers in credit", "purchasing", "nation", "1.0.0", "vendors", ["s_acctbal > 0"], ["s_nationkey"], "count"),
    ("part_price", "Mean price of larger parts", "catalogue", "size", "1.0.0", "goods", ["p_size > 12"], ["p_size"], "avg"),
    ("text_length", "Characters less texts", "content", "language and source", "1.0.0", "content", [], ["source"], "sum"),
    ("line_tax", "Mean tax", None, "line", "1.0.0", "tax", [], ["l_linenumber"], "avg"),
]
_RULES = "metric_id string, description string, owner string, grain string, contract_version string, metric_family string, required_filters array<string>, required_dimensions array<string>, required_function string"


def contracts(spark):
    nothing = {c: F.array().cast("array<string>") for c in ("forbidden_filters", "positive_components", "negative_components")}
    return spark.createDataFrame(CONTRACTS, _RULES).withColumns({**nothing, "timezone": F.lit(None).cast("string")})


def suite_of(spec: MetricSpec) -> Suite:
    return Suite("contract", [A.NotNull("keys", tuple(spec.dim_names)), A.MetricValue("total", spec.measure_names[0], min_value=0.0)])


_stored: dict[tuple, str] = {}


def corpus_matrix(spark, d):
    """The kill matrix of the corpus over the tables in ``d``, stored once a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stored or not path_exists(spark, _stored[key]):
        cases = [(spec, t(spark, d, table), [suite_of(spec)], {}) for spec, table in METRICS.values()]
        path = scratch_path(spark, "corpus-matrix")
        scoring.corpus_matrix(cases).write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def corpus_catalogue(spark, d):
    return catalogue(spark, [(spec, t(spark, d, table), table) for spec, table in METRICS.values()])


# --- the same in SQL ---------------------------------------------------------------------------


def quoted(text) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def _list(texts) -> str:
    return f"[{', '.join(map(quoted, texts))}]::VARCHAR[]"


def result_sql(spec: MetricSpec, table: str) -> str:
    """The metric's own text, its values rounded as results are compared."""
    values = [f"round(CAST({m} AS DOUBLE), 4) AS {m}" for m in spec.measure_names]
    return f"SELECT {', '.join(spec.dim_names + values)} FROM ({metric_text(spec, table)})"


def diff_sql(spec: MetricSpec, fault: str, edited: MetricSpec, table: str, keys: str) -> str:
    """One row: ``keys``, operator, base_rows, differing_rows of one variant."""
    names = spec.dim_names + spec.measure_names
    lost = [f"NULL AS {spec.dim_names[-1]}"] if fault == "GRAIN_DROP" else []
    kept = [c for c in names if f"NULL AS {c}" not in lost]
    variant = f"SELECT {', '.join(kept + lost)}, FALSE AS b FROM ({result_sql(edited, table)})"
    both = f"SELECT {', '.join(kept + [c for c in names if c not in kept])}, TRUE AS b FROM ({result_sql(spec, table)}) UNION ALL {variant}"
    counts = f"SELECT count(*) FILTER (WHERE b) AS nb, count(*) FILTER (WHERE NOT b) AS nv FROM ({both}) GROUP BY {', '.join(names)}"
    return f"SELECT {keys}, {quoted(fault)} AS operator, sum(nb) AS base_rows, sum(abs(nb - nv)) AS differing_rows FROM ({counts})"


def _matrix_cte() -> str:
    rows = [
        diff_sql(spec, fault, edited, table, f"{quoted(name)} AS model")
        for name, (spec, table) in METRICS.items()
        for fault, edited in edits(spec).items()
        if (name, fault) not in UNPLANNABLE
    ]
    return " UNION ALL ".join(rows)


def _catalogue_cte() -> str:
    def row(name, fault, own, spec, table):
        description = None if fault == BASE else describe(fault, spec, own)
        return f"({quoted(name)}, {quoted(fault)}, {quoted(metric_text(own, table))}, {_list(p.sql for p in own.filters)}, {_list(e for _, e in own.dims)}, {_list(aggregate_calls(own))}, {quoted(description)})"

    rows = [row(name, fault, own, spec, table) for name, (spec, table) in METRICS.items() for fault, own in [(BASE, spec), *edits(spec).items()]]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v(metric, variant, sql, held, grouped, calls, mutation_description)"


def _contracts_cte() -> str:
    rows = [f"({', '.join(quoted(v) for v in c[:6])}, {_list(c[6])}, {_list(c[7])}, {quoted(c[8])})" for c in CONTRACTS]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v(metric, description, owner, grain, contract_version, metric_family, filters, dimensions, func)"


#: gated: every variant with its first reason for rejection (NULL: kept).
GATED = f"""
    matrix AS ({_matrix_cte()}),
    catalogue AS ({_catalogue_cte()}),
    contracts AS ({_contracts_cte()}),
    checked AS (
      SELECT k.*, c.metric IS NOT NULL AS known, description, owner, grain, contract_version, coalesce(metric_family, k.metric) AS family,
             list_concat(list_transform(list_filter(filters, lambda x: NOT list_contains(held, x)), lambda x: 'population: required_filters'),
                         list_transform(list_filter(dimensions, lambda x: len(list_filter(grouped, lambda y: contains(y, x) OR contains(x, y))) = 0), lambda x: 'grain: required_dimensions'),
                         CASE WHEN func IS NOT NULL AND len(list_filter(calls, lambda x: starts_with(upper(x), upper(func) || '('))) = 0 THEN ['aggregation: required_function'] ELSE [] END) AS found
      FROM catalogue k LEFT JOIN contracts c USING (metric)),
    candidates AS (
      SELECT v.metric, v.variant AS mutation_type, v.mutation_description, v.sql AS rejected_sql, b.sql AS chosen_sql, v.description, v.owner, v.grain, v.contract_version, v.family, v.known,
             CASE WHEN v.known THEN v.found ELSE [] END AS violations, b.known AND len(b.found) = 0 AS chosen_ok, base_rows, differing_rows,
             ('0x' || md5(v.family)[1:8])::BIGINT % 100 AS bucket
      FROM checked v JOIN checked b ON b.metric = v.metric AND b.variant = 'BASE' LEFT JOIN matrix m ON m.model = v.metric AND m.operator = v.variant
      WHERE v.variant <> 'BASE'),
    placed AS (SELECT *, CASE WHEN bucket < 70 THEN 'train' WHEN bucket < 85 THEN 'validation' ELSE 'holdout' END AS split FROM candidates),
    gated AS (
      SELECT *, CASE WHEN NOT known OR coalesce(owner, '') = '' OR coalesce(grain, '') = '' THEN 'incomplete_contract'
                     WHEN base_rows = 0 THEN 'insufficient_fixture_contrast' WHEN NOT chosen_ok THEN 'chosen_contract_failure'
                     WHEN chosen_sql = rejected_sql THEN 'identical_pair'
                     WHEN {{split}} THEN 'outside_split'
                     WHEN differing_rows IS NULL THEN 'unexecutable' WHEN differing_rows = 0 THEN 'equivalent_on_fixture'
                     WHEN len(violations) = 0 THEN 'unresolved_preference' END AS rejection
      FROM placed)"""

OUTSIDE = """NOT ((split = 'train' AND mutation_type IN ('FILTER_DROP', 'AGGREGATION_SWAP', 'COALESCE_BYPASS'))
                       OR (split = 'validation' AND mutation_type IN ('BOUNDARY_SHIFT', 'DISTINCT_DROP'))
                       OR (split = 'holdout' AND mutation_type IN ('GRAIN_DROP', 'MATH_OPERATOR_INVERT', 'JOIN_PREDICATE_DROP')))"""


# --- replay on snapshots -------------------------------------------------------------------------

#: Name and time of the snapshots of ``events``: each holds what had happened before.
SNAPSHOTS = [("day-08", dt.datetime(2024, 1, 8)), ("day-20", dt.datetime(2024, 1, 20))]
REPLAYED = ("click", "purchase", "signup", "view")
REQUIRED = "user_id % 3 <> 0"


def event_metric(kind: str) -> MetricSpec:
    """Value per user and day; what its contract requires depends on the user alone."""
    return _metric(
        kind,
        (("user_id", "user_id"), ("day", "dayofmonth(ts)")),
        (Measure("total", (Term("value"),)),),
        ("event_type", "=", quoted(kind)),
        ("value", ">", "20"),
        ("user_id % 3", "<>", "0"),
    )


def _replay_ctes() -> str:
    """pairs: differing rows of each variant on each snapshot and whether it lets a user in whom the contract keeps out."""
    parts = []
    for snapshot, taken in SNAPSHOTS:
        source = f"(SELECT * FROM events WHERE ts < TIMESTAMP '{taken}')"
        for kind in REPLAYED:
            spec = event_metric(kind)
            for fault, edited in edits(spec).items():
                leak = f"EXISTS (SELECT 1 FROM ({metric_text(edited, source)}) o JOIN {source} s ON o.user_id = s.user_id WHERE NOT (s.{REQUIRED})) AS caught"
                diff = diff_sql(spec, fault, edited, source, f"{quoted(kind)} AS metric_id, {quoted(snapshot)} AS snapshot_id")
                parts.append(f"SELECT *, {leak} FROM ({diff})")
    spans = " ".join(f"WHEN ts >= TIMESTAMP '{taken}' THEN {quoted(name)}" for name, taken in reversed(SNAPSHOTS))
    return f"""
    variants AS ({" UNION ALL ".join(parts)}),
    spots AS (
      SELECT metric_id, snapshot_id, count(*) FILTER (WHERE differing_rows > 0) AS valid_defects,
             count(*) FILTER (WHERE differing_rows > 0 AND NOT caught) AS undetected_defects,
             round(count(*) FILTER (WHERE differing_rows > 0 AND caught)::DOUBLE / nullif(count(*) FILTER (WHERE differing_rows > 0), 0) * 100, 1) AS effective_catch_pct
      FROM variants GROUP BY ALL),
    placed AS (SELECT trace_id, metric_id, CASE {spans} END AS snapshot_id FROM selected JOIN (SELECT 'trace-' || event_id AS trace_id, ts FROM events) USING (trace_id))"""


REPLAY = _replay_ctes()
