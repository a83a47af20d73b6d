"""Replay of logged queries: which of them would hide a fault?"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.assertions import MetricValue, Population
from plumbline.operators.scoring import SURVIVED, catch_scores, kill_matrix, side_by_side
from plumbline.operators.snapshots import SnapshotRegistry
from plumbline.operators.suites import Suite
from plumbline.plans.spec import MetricSpec
from plumbline.session import stored

REPLAYED_DECISIONS = ("ALLOW", "AUDIT")


def select_traces(traces: DataFrame) -> DataFrame:
    """Traces that passed the gateway and name both a metric and its SQL."""
    named = (F.coalesce("metric_id", F.lit("")) != "") & (F.coalesce("sql", F.lit("")) != "")
    return traces.where(F.col("decision").isin(*REPLAYED_DECISIONS) & named)


#: Bits of the id's hash that decide on a trace.
HASH_BITS = 60


def _place(identity: Column) -> Column:
    return F.conv(F.substring(F.md5(identity), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def sample_traces(
    traces: DataFrame,
    fraction: float,
    per_stratum: Mapping[tuple[str, str], float] | None = None,
    strata: Sequence[str] = ("agent_id", "metric_id"),
) -> DataFrame:
    """Deterministic stratified sample: the same traces are taken on every run.

    A trace is kept by the hash of its id, so no stratum is counted or sorted.
    ``per_stratum`` gives strata of their own fractions.
    """
    share = F.lit(float(fraction))
    for values, other in (per_stratum or {}).items():
        match = F.lit(True)
        for column, value in zip(strata, values, strict=True):
            match = match & (F.col(column) == value)
        share = F.when(match, F.lit(float(other))).otherwise(share)
    return traces.where(_place(F.col("trace_id").cast("string")) < share * float(2**HASH_BITS))


def sample_exact(traces: DataFrame, size: int, per_stratum: Mapping[tuple, int] | None = None, strata: Sequence[str] = ("agent_id", "metric_id")) -> DataFrame:
    """Exactly ``size`` traces of each stratum, all of a smaller one: those whose ids have the least hashes.

    The same traces on every run and partitioning; of traces with one id the one whose other values hash
    lowest comes first.  Each task keeps its own least rows of a stratum, so a hot stratum
    moves ``size`` rows from each task.  ``per_stratum`` gives strata sizes of their own; a NULL stratum is one.
    """
    wanted = F.lit(size)
    for values, other in (per_stratum or {}).items():
        match = F.lit(True)
        for column, value in zip(strata, values, strict=True):
            match = match & F.col(column).eqNullSafe(F.lit(value))
        wanted = F.when(match, F.lit(other)).otherwise(wanted)
    identity = F.coalesce(F.col("trace_id").cast("string"), F.lit(""))
    order = [_place(identity), identity, F.xxhash64(*[F.col(f"`{c}`") for c in traces.columns])]
    most = max([size, *(per_stratum or {}).values()])
    # the constant bound lets Spark cut each task's rows before they are shuffled
    ranked = traces.withColumn("__n", F.row_number().over(W.partitionBy(*strata).orderBy(*order))).where(F.col("__n") <= most)
    return ranked.where(F.col("__n") <= wanted).drop("__n")


def suite_specs(contracts: DataFrame) -> DataFrame:
    """Assertions implied by each contract, one row each.

    One population check per required filter, and a value of at least 0.
    """
    filters = F.transform(
        F.coalesce("required_filters", F.array().cast("array<string>")),
        lambda f: F.struct(F.lit("population").alias("type"), f.alias("argument")),
    )
    value = F.array(F.struct(F.lit("metric_value").alias("type"), F.lit("min_value=0").alias("argument")))
    return contracts.select("metric_id", F.inline(F.concat(filters, value)))


def suite_for(metric: str, required_filters: Sequence[str], source_table: str, join_key: str, column: str | None = None) -> Suite:
    """The same suite for one metric, ready to run."""
    suite = Suite(f"contract_suite_{metric}")
    for predicate in required_filters:
        suite.add(Population(f"population: {predicate}", source_table, predicate, join_key))
    return suite.add(MetricValue("metric value not negative", column or metric, min_value=0.0))


def blind_spots(evaluations: DataFrame, by: Sequence[str] = ("trace_id", "metric_id")) -> DataFrame:
    """Catch score of each trace, and whether its contract is underspecified."""
    scores = catch_scores(evaluations, by)
    return scores.select(
        *by,
        "effective_catch_pct",
        "valid_defects",
        F.col("surviving").alias("undetected_defects"),
        (F.col("surviving") > 0).alias("contract_underspecified"),
    )


@dataclass(frozen=True)
class Replayable:
    """A metric that traces can be replayed on: its spec, the table it reads, and the suite its contract implies."""

    spec: MetricSpec
    table: str
    suite: Suite


def replay_matrices(wanted: Sequence[tuple[str, str]], registry: SnapshotRegistry, metrics: Mapping[str, Replayable]) -> DataFrame | None:
    """Kill matrices of (metric, snapshot) pairs, each run once: metric_id, snapshot_id and the columns of the matrix; None for none."""
    def matrix(metric, snapshot):
        one = metrics[metric]
        tables = registry.tables_of(metric, snapshot)
        found = kill_matrix(one.spec, tables[one.table], [one.suite], tables)
        return found.select(F.lit(metric).alias("metric_id"), F.lit(snapshot).alias("snapshot_id"), *found.columns)

    return side_by_side([partial(matrix, *pair) for pair in wanted]) if wanted else None


def replay(traces: DataFrame, registry: SnapshotRegistry, metrics: Mapping[str, Replayable], at: str = "ts") -> tuple[DataFrame, DataFrame | None]:
    """(results, evaluations) of the traces that passed the gateway.

    A trace is judged on the snapshot that held when it ran.  What its metric's suite
    overlooks there does not depend on the trace, so one kill matrix is run for each
    distinct metric and snapshot and joined back, however many traces there are; only
    those distinct pairs come to the driver.  ``results`` has trace_id, metric_id, snapshot_id, ``status`` (replayed,
    no_metric, no_snapshot) and for replayed ones the columns of :func:`blind_spots`;
    ``evaluations`` the variants of each pair, stored.
    """
    named = registry.resolve(select_traces(traces), at)
    known = F.col("metric_id").isin(*metrics)
    status = F.when(~known, "no_metric").when(F.col("snapshot_id").isNull(), "no_snapshot").otherwise("replayed")
    named = stored(named.select("trace_id", "metric_id", "snapshot_id", status.alias("status")), "replayed-traces")
    pairs = named.where("status = 'replayed'").select("metric_id", "snapshot_id").distinct().collect()
    evaluations = replay_matrices(sorted(map(tuple, pairs)), registry, metrics)
    if evaluations is None:
        nothing = {"effective_catch_pct": "double", "valid_defects": "bigint", "undetected_defects": "bigint", "contract_underspecified": "boolean"}
        return named.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in nothing.items())), None
    evaluations = stored(evaluations, "replayed-variants")
    return named.join(blind_spots(evaluations, ["metric_id", "snapshot_id"]), ["metric_id", "snapshot_id"], "left"), evaluations


def surviving_spots(evaluations: DataFrame) -> DataFrame:
    return evaluations.where(F.col("classification") == SURVIVED)


# Phrasings of a fault description that name the lost clause.
PREDICATE_PATTERN = r"(?i)(?:Drop WHERE clause predicate|Dropped predicate|Drop predicate):\s*(.+)"
DIMENSION_PATTERN = r"(?i)(?:Drop GROUP BY dimension|Dropped dimension):\s*(.+)"


def suggest_invariants(spots: DataFrame, by: Sequence[str] = ("metric_id",)) -> DataFrame:
    """Contract additions that would catch the surviving faults, de-duplicated.

    Input: ``mutation_type`` and ``description``.  Output: invariant class,
    suggestion and how many spots support it.
    """
    def clause(pattern):
        found = F.trim(F.regexp_extract("description", pattern, 1))
        return F.when(found != "", found).otherwise(F.col("description"))

    fault = F.col("mutation_type")
    kind = (
        F.when(fault == "FILTER_DROP", "population_required")
        .when(fault == "GRAIN_DROP", "grain_dimensions")
        .when(fault.isin("AGGREGATION_SWAP", "MATH_OPERATOR_INVERT"), "aggregation_review_needed")
        .when(fault == "BOUNDARY_SHIFT", "boundary_rules")
    )
    suggestion = (
        F.when(fault == "FILTER_DROP", clause(PREDICATE_PATTERN))
        .when(fault == "GRAIN_DROP", clause(DIMENSION_PATTERN))
        .otherwise(F.col("description"))
    )
    rows = spots.select(*by, kind.alias("invariant"), suggestion.alias("suggestion"))
    return (
        rows.where(F.col("invariant").isNotNull())
        .groupBy(*by, "invariant", "suggestion")
        .agg(F.count(F.lit(1)).alias("spots"))
    )
