"""Preference pairs from kill matrices, and replay of traces on snapshots."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from tables import TABLES, table

from plumbline.operators import assertions as A
from plumbline.operators import pairs as PD
from plumbline.operators import replay as RP
from plumbline.operators import scoring
from plumbline.operators.snapshots import SnapshotRegistry
from plumbline.operators.suites import Suite
from plumbline.plans.catalogue import catalogue, metric_rows, metric_text
from plumbline.plans.corpus import CORPUS
from plumbline.plans.spec import Measure, MetricSpec, Predicate, Ratio, Term
from plumbline.plans.variants import derive


def sorted_values(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", list(TABLES))
def test_the_text_computes_what_the_spec_and_its_variants_compute(spark, name):
    spec, df = CORPUS[name], table(spark, name)
    df.createOrReplaceTempView("source")
    for own in [spec, *(v.spec for v in derive(spec, df) if v.error is None)]:
        assert sorted_values(spark.sql(metric_text(own, "source"))) == sorted_values(own.run(df)), metric_text(own, "source")


def test_texts_and_descriptions():
    spec = MetricSpec(
        "m",
        (("a", "x"), ("b", "year(t)")),
        (Measure("s", (Term("v", default=0.0), Term("w", when="k = 1", sign=-1))), Ratio("r", Term("u", agg="count", distinct=True), Term("1", agg="count"))),
        (Predicate("p", ">", "1"), Predicate("q IS NOT NULL")),
    )
    assert metric_text(spec, "src") == (
        "SELECT x AS a, year(t) AS b, SUM(COALESCE(v, 0.0)) - SUM(CASE WHEN k = 1 THEN w ELSE 0.0 END) AS s, "
        "CAST(COUNT(DISTINCT u) AS DOUBLE) / NULLIF(CAST(COUNT(1) AS DOUBLE), 0) AS r FROM src WHERE p > 1 AND q IS NOT NULL GROUP BY x, year(t)"
    )
    assert metric_text(MetricSpec("m", (), (Measure("n", (Term("1", agg="count", sign=-1),)),)), "src") == "SELECT -COUNT(1) AS n FROM src"


def test_descriptions_name_the_lost_clause(spark):
    rows = {r[1]: r[7] for r in metric_rows(CORPUS["net_revenue"], table(spark, "net_revenue"), "transactions")}
    assert rows == {
        "BASE": None,
        "FILTER_DROP": "Dropped predicate: status = 'active'",
        "BOUNDARY_SHIFT": "Shifted boundary: region = 'NA'",
        "AGGREGATION_SWAP": "Changed aggregate: SUM(CASE WHEN type = 'invoice' THEN amount ELSE 0.0 END)",
        "GRAIN_DROP": "Dropped dimension: date_trunc('month', transaction_date)",
        "MATH_OPERATOR_INVERT": "Inverted sign: SUM(CASE WHEN type = 'refund' THEN amount ELSE 0.0 END)",
    }
    spots = spark.createDataFrame([("net_revenue", f, d) for f, d in rows.items() if d], "metric_id string, mutation_type string, description string")
    found = {(r["invariant"], r["suggestion"]) for r in RP.suggest_invariants(spots).collect()}
    assert ("population_required", "status = 'active'") in found and ("grain_dimensions", "date_trunc('month', transaction_date)") in found


RULES = (
    "metric_id string, description string, owner string, grain string, contract_version string, metric_family string, required_filters array<string>, "
    "forbidden_filters array<string>, required_dimensions array<string>, required_function string, positive_components array<string>, "
    "negative_components array<string>, timezone string"
)


def contract(metric, filters=(), dimensions=(), **own):
    fields = {"description": None, "owner": "o", "grain": "g", "contract_version": "1.1.0", "metric_family": None, "function": None, **own}
    return (metric, fields["description"], fields["owner"], fields["grain"], fields["contract_version"], fields["metric_family"], list(filters), None, list(dimensions), fields["function"], None, None, None)


def corpus(spark, *names):
    matrix = scoring.corpus_matrix([(CORPUS[n], table(spark, n), [Suite("s", [A.RowCount("rows", 1)]), Suite("t", [A.NonNegative("sign")])], {}) for n in names])
    return matrix, catalogue(spark, [(CORPUS[n], table(spark, n), n) for n in names])


def test_pairs_and_rejects_split_the_catalogue(spark):
    names = ["net_revenue", "average_order_value", "monthly_active_users", "b2b_saas_arr", "marketplace_take_rate"]
    matrix, texts = corpus(spark, *names)
    contracts = spark.createDataFrame(
        [
            contract("net_revenue", ["(STATUS='active')", "region = 'NA'"], ["customer_id"], description="revenue"),
            contract("average_order_value", ["order_status = 'shipped'"]),
            contract("monthly_active_users", ["is_bot = false"], owner=" "),
            contract("b2b_saas_arr", ["status = 'active'"], ["customer_id"], metric_family="arr"),
        ],
        RULES,
    )
    pairs, rejects = PD.build_pairs(matrix, contracts, texts, by_split=False)
    kept = {(r["contract_id"], r["mutation_type"]): r for r in pairs.collect()}
    left = {(r["metric"], r["mutation_type"]): r for r in rejects.collect()}
    every = {(r["metric"], r["variant"]) for r in texts.where("variant <> 'BASE'").collect()}
    assert not kept.keys() & left.keys() and kept.keys() | left.keys() == every
    assert {left[k]["rejection"] for k in left if k[0] == "average_order_value"} == {"chosen_contract_failure"}
    assert {left[k]["rejection"] for k in left if k[0] in ("monthly_active_users", "marketplace_take_rate")} == {"incomplete_contract"}
    row = kept["net_revenue", "FILTER_DROP"]
    assert row["prompt"] == "revenue" and "status" not in row["rejected_sql"] and row["rejected_evidence"]["violations"] == ["population: required_filters"]
    assert row["rejected_evidence"]["rejection_basis"] == ["CONTRACT_VIOLATION", "RESULT_DIVERGENCE"] and row["split"] == PD_SPLIT["net_revenue"]
    assert left["net_revenue", "MATH_OPERATOR_INVERT"]["rejection"] == "unresolved_preference"
    assert ("net_revenue", "GRAIN_DROP") in left  # the contract wants the customer alone
    assert kept["b2b_saas_arr", "GRAIN_DROP"]["metric_family"] == "arr"
    strict, _ = PD.build_pairs(matrix, contracts, texts)
    allowed = {"train": "FILTER_DROP AGGREGATION_SWAP COALESCE_BYPASS", "validation": "BOUNDARY_SHIFT DISTINCT_DROP", "holdout": "GRAIN_DROP MATH_OPERATOR_INVERT JOIN_PREDICATE_DROP"}
    assert all(r["mutation_type"] in allowed[r["split"]].split() for r in strict.collect())


PD_SPLIT = {}


@pytest.fixture(autouse=True)
def _split(spark):
    rows = spark.createDataFrame([("net_revenue",)], "f string").select(PD.family_split(F.col("f")).alias("s"))
    PD_SPLIT["net_revenue"] = rows.first()["s"]


def test_variants_without_a_result_are_unexecutable(spark):
    matrix, texts = corpus(spark, "average_order_value")
    contracts = spark.createDataFrame([contract("average_order_value")], RULES)
    for results in (matrix.limit(0), matrix.withColumns({"runtime_error": F.lit(True), "equivalent": F.lit(False)})):
        pairs, rejects = PD.build_pairs(results, contracts, texts, by_split=False)
        assert pairs.count() == 0 and {r["rejection"] for r in rejects.collect()} == {"unexecutable"}
    nothing, rejects = PD.build_pairs(matrix.withColumn("base_rows", F.lit(0)), contracts, texts, by_split=False)
    assert nothing.count() == 0 and {r["rejection"] for r in rejects.collect()} == {"insufficient_fixture_contrast"}
    assert [f.count() for f in PD.build_pairs(matrix, contracts, texts.limit(0))] == [0, 0]


# --- snapshots and replay ------------------------------------------------------------------------


def at(day, hour=0):
    return dt.datetime(2024, 3, day, hour)


@pytest.fixture
def registry(spark, tmp_path):
    rows = [(u, d, float(u * d), "click" if u % 2 else "view") for u in range(6) for d in (1, 2, 3, 4)]
    events = spark.createDataFrame(rows, "user_id int, day int, value double, kind string")
    found = SnapshotRegistry(spark, str(tmp_path / "snapshots"))
    for name, last in (("s1", 2), ("s2", 3), ("s3", 4)):
        found.write(name, {"events": events.where(F.col("day") <= last)})
    found.register({"click": ["events"], "view": ["events"]}, "s1", at(2))
    found.register({"click": ["events"]}, "s2", at(3))
    found.register({"click": ["events"], "view": ["events"]}, "s3", at(3))
    return found


def metric(kind):
    filters = (Predicate("kind", "=", f"'{kind}'"), Predicate("user_id % 3", "<>", "0"))
    return MetricSpec(kind, (("user_id", "user_id"), ("day", "day")), (Measure("total", (Term("value"),)),), filters)


METRICS = {k: RP.Replayable(metric(k), "events", RP.suite_for(k, ["user_id % 3 <> 0"], "events", "user_id", "total")) for k in ("click", "view")}
TRACES = [
    ("before", "click", at(1, 23), "ALLOW", "q"), ("exactly", "click", at(2), "ALLOW", "q"), ("between", "view", at(2, 5), "AUDIT", "q"),
    ("tie", "click", at(3), "ALLOW", "q"), ("late", "view", at(30), "ALLOW", "q"), ("no time", "click", None, "ALLOW", "q"),
    ("other", "signup", at(5), "ALLOW", "q"), ("denied", "click", at(5), "DENY", "q"), ("no text", "click", at(5), "ALLOW", ""), (None, "click", at(5), "ALLOW", "q"),
]


def traces(spark, rows=TRACES):
    return spark.createDataFrame(rows, "trace_id string, metric_id string, ts timestamp, decision string, sql string")


def test_a_trace_takes_the_snapshot_that_held(spark, registry):
    got = {r["trace_id"]: r["snapshot_id"] for r in registry.resolve(traces(spark)).collect()}
    assert got == {"before": None, "exactly": "s1", "between": "s1", "tie": "s3", "late": "s3", "no time": None, "other": None, "denied": "s3", "no text": "s3", None: "s3"}
    assert registry.resolve(traces(spark)).count() == len(TRACES)


def test_a_snapshot_reads_its_partition_only(registry):
    one = registry.load("events", "s2")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_id" in plan and one.agg(F.max("day")).first()[0] == 3
    assert sorted(registry.tables_of("click", "s2")) == ["events"] and registry.tables_of("view", "s2") == {}


def test_replay_runs_one_matrix_for_each_metric_and_snapshot(spark, registry, monkeypatch):
    runs = []

    def counted(spec, df, *rest):
        runs.append((spec.name, df.agg(F.max("day")).first()[0]))
        return scoring.kill_matrix(spec, df, *rest)

    monkeypatch.setattr(RP, "kill_matrix", counted)
    many = TRACES + [(f"t{i}", "click", at(4, i % 24), "ALLOW", "q") for i in range(300)]
    results, evaluations = RP.replay(traces(spark, many), registry, METRICS)
    assert sorted(runs) == [("click", 2), ("click", 4), ("view", 2), ("view", 4)]
    got = {r["trace_id"]: r for r in results.collect()}
    assert len(got) == len(many) - 2 and got["before"]["status"] == "no_snapshot" and got["other"]["status"] == "no_metric"
    assert got["other"]["effective_catch_pct"] is None and got["no time"]["status"] == "no_snapshot"
    own = evaluations.where("metric_id = 'click' AND snapshot_id = 's3'")
    valid = own.where("classification LIKE 'VALID%'").count()
    survived = own.where("classification = 'VALID_DEFECT_SURVIVED'").count()
    assert valid and survived
    for trace in ("tie", "t7", None):
        assert (got[trace]["valid_defects"], got[trace]["undetected_defects"], got[trace]["contract_underspecified"]) == (valid, survived, True)
    direct = scoring.kill_matrix(metric("click"), registry.load("events", "s3"), [METRICS["click"].suite], {"events": registry.load("events", "s3")})
    key = ["operator", "differing_rows", "classification"]
    assert sorted_values(own.select(key)) == sorted_values(direct.select(key))


def test_replay_without_replayable_traces(spark, registry):
    results, evaluations = RP.replay(traces(spark, TRACES[:1]), registry, METRICS)
    assert evaluations is None and results.first()["status"] == "no_snapshot"
    assert RP.replay(traces(spark).limit(0), registry, METRICS)[0].count() == 0


def test_an_exact_sample_has_its_size_whatever_the_partitioning(spark):
    rows = [(f"t{i}", "hot", "m", i % 3) for i in range(200)] + [(f"u{i}", "a", None, i) for i in range(9)] + [("same", "b", "m", i) for i in range(6)] + [(None, "c", "m", 1), (None, "c", "m", 2)]
    df = spark.createDataFrame(rows, "trace_id string, agent_id string, metric_id string, k int")
    taken = [sorted(map(tuple, RP.sample_exact(df.repartition(n), 4, {("hot", "m"): 50, ("a", None): 7}).collect()), key=repr) for n in (1, 5, 13)]
    assert taken[0] == taken[1] == taken[2] and set(taken[0]) <= set(rows)
    sizes = {}
    for r in taken[0]:
        sizes[r[1]] = sizes.get(r[1], 0) + 1
    assert sizes == {"hot": 50, "a": 7, "b": 4, "c": 2}
    smaller = set(map(tuple, RP.sample_exact(df, 4, {("hot", "m"): 20}).collect()))
    assert {r for r in smaller if r[1] == "hot"} < set(taken[0])
    plan = RP.sample_exact(df, 4)._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan.split("Exchange hashpartitioning", 1)[1]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle
    assert RP.sample_exact(df.limit(0), 4).count() == 0
