import pytest
from tables import EXPECTED, TABLES, first, rows_by, table

from plumbline.operators import assertions as A
from plumbline.operators import scoring
from plumbline.operators.contrast import contrast_score, profile_contrast
from plumbline.operators.suites import Suite
from plumbline.plans.corpus import CORPUS
from plumbline.plans.spec import Measure, MetricSpec, Predicate, Term
from plumbline.plans.variants import BASE, derive, run_one, run_variants


@pytest.mark.parametrize("name", list(TABLES))
def test_metric_values(spark, name):
    spec = CORPUS[name]
    got = {}
    for row in spec.run(table(spark, name)).collect():
        key = str(row[spec.dim_names[0]])[:7] if name == "monthly_active_users" else (row[0] if spec.dims else None)
        got[key] = round(row[spec.measure_names[0]], 4)
    assert got == EXPECTED[name][0]


@pytest.mark.parametrize("name", list(TABLES))
def test_contrast_score(spark, name):
    score = first(contrast_score(profile_contrast(table(spark, name))))
    assert score["score_pct"] == EXPECTED[name][1]


@pytest.mark.parametrize("store", [False, True])
@pytest.mark.parametrize("name", list(TABLES))
def test_every_variant_equals_its_own_run(spark, name, store):
    """The fused scan gives what each perturbed spec gives when it is run alone."""
    spec, df = CORPUS[name], table(spark, name)
    fused = run_variants(spec, df, store=store).collect()
    for variant in derive(spec, df):
        if variant.error:
            continue
        alone = sorted(
            (tuple(str(r[d]) for d in variant.spec.dim_names), round(float(r[m]), 6) if r[m] is not None else None)
            for r in variant.spec.run(df).collect()
            for m in spec.measure_names
        )
        ours = sorted(
            (tuple(str(r[d]) for d in variant.spec.dim_names), round(r[m], 6) if r[m] is not None else None)
            for r in fused
            if r["variant"] == variant.fault
            for m in spec.measure_names
        )
        assert ours == alone, variant.fault


def test_variants_of_net_revenue(spark):
    spec = CORPUS["net_revenue"]
    faults = [v.fault for v in derive(spec, table(spark, "net_revenue"))]
    assert faults == ["FILTER_DROP", "BOUNDARY_SHIFT", "AGGREGATION_SWAP", "GRAIN_DROP", "MATH_OPERATOR_INVERT"]


def test_distinct_drop_counts_logins(spark):
    spec = CORPUS["monthly_active_users"]
    values = rows_by(run_one(spec, table(spark, "monthly_active_users"), "DISTINCT_DROP"), "variant")
    assert values[BASE]["active_users"] == 3 and values["DISTINCT_DROP"]["active_users"] == 4


def test_sum_over_text_is_a_runtime_error(spark):
    spec = CORPUS["monthly_active_users"]
    errors = {v.fault: v.error for v in derive(spec, table(spark, "monthly_active_users"))}
    assert errors["AGGREGATION_SWAP"] is not None and errors["FILTER_DROP"] is None


def test_fanout_closed_form(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "k string, v double")
    right = spark.range(7)
    spec = MetricSpec(
        "m",
        dims=(("k", "k"),),
        measures=(
            Measure("total", (Term("v"),)),
            Measure("mean", (Term("v", agg="avg"),)),
            Measure("n", (Term("v", agg="count"),)),
            Measure("distinct", (Term("v", agg="count", distinct=True),)),
        ),
    )
    ours = rows_by(run_variants(spec, left, other_side=right).where("variant = 'JOIN_PREDICATE_DROP'"), "k")
    real = rows_by(spec.run(left.crossJoin(right)), "k")
    for key, row in real.items():
        assert {m: ours[key][m] for m in spec.measure_names} == {m: float(row[m]) for m in spec.measure_names}


def test_rolled_up_grain_keeps_null_terms_apart(spark):
    """A group whose first term is NULL still contributes its other terms to the coarser grain."""
    rows = [("a", 1, None, 5.0), ("a", 2, 7.0, 1.0), ("b", 1, 2.0, None)]
    df = spark.createDataFrame(rows, "k string, day int, v double, w double")
    spec = MetricSpec(
        "m",
        (("k", "k"), ("day", "day")),
        (
            Measure("net", (Term("v"), Term("w", sign=-1))),
            Measure("mean", (Term("v", agg="avg"),)),
            Measure("n", (Term("v", agg="count"),)),
            Measure("low", (Term("w", agg="min"),)),
        ),
    )
    kept = rows_by(run_variants(spec, df).where("variant = 'GRAIN_DROP'"), "k")
    rolled = rows_by(run_variants(spec, df, store=True).where("variant = 'GRAIN_DROP'"), "k")
    assert rolled == kept and rolled["a"]["net"] == 1.0 and rolled["b"]["net"] is None


def test_coalesce_bypass_keeps_the_first_argument(spark):
    df = spark.createDataFrame([("a", None), ("a", 4.0)], "k string, v double")
    spec = MetricSpec("m", (("k", "k"),), (Measure("mean", (Term("v", agg="avg", default=0.0),)),))
    values = rows_by(run_one(spec, df, "COALESCE_BYPASS"), "variant")
    assert values[BASE]["mean"] == 2.0 and values["COALESCE_BYPASS"]["mean"] == 4.0


def test_boundary_prefers_greater_then_less_then_equal():
    spec = MetricSpec("m", (), (Measure("n", (Term("1", agg="count"),)),), (Predicate("a", "=", "1"), Predicate("b", "<", "2")))
    from plumbline.plans.variants import boundary_shift

    assert [p.op for p in boundary_shift(spec).filters] == ["=", "<="]


def _suites():
    standard = Suite("standard", [A.NotNull(columns=("customer_id", "reporting_month", "net_revenue"))])
    semantic = Suite(
        "semantic",
        [
            A.NotNull(columns=("customer_id", "reporting_month", "net_revenue")),
            A.Population("active only", "transactions", "status = 'active'"),
            A.Population("NA only", "transactions", "region = 'NA'"),
            A.MetricValue("total", "net_revenue", expected=2800.0, tolerance_pct=5.0),
            A.Singular("no negative month", "SELECT * FROM {{ model }} WHERE net_revenue < 0"),
        ],
    )
    return [standard, semantic]


def test_kill_matrix_of_net_revenue(spark):
    df = table(spark, "net_revenue")
    matrix = scoring.kill_matrix(CORPUS["net_revenue"], df, _suites(), {"transactions": df})
    found = {(r["suite"], r["operator"]): r for r in matrix.collect()}
    assert len(found) == 10
    assert found["semantic", "FILTER_DROP"]["assertions_failed"] == ["active only", "total"]
    assert found["semantic", "FILTER_DROP"]["classification"] == scoring.DETECTED
    assert found["standard", "FILTER_DROP"]["classification"] == scoring.SURVIVED
    # the lost key is NULL in the coarser result, which the null test notices
    assert found["standard", "GRAIN_DROP"]["classification"] == scoring.DETECTED
    scores = rows_by(scoring.catch_scores(matrix, ["suite"]), "suite")
    for row in scores.values():
        assert row["generated"] == row["equivalent"] + row["unexecutable"] + row["valid_defects"]
        assert row["valid_defects"] == row["detected"] + row["surviving"]
    assert scores["semantic"]["effective_catch_pct"] > scores["standard"]["effective_catch_pct"]


def test_kill_matrix_counts_empty_variants(spark):
    """A variant that loses every row fails the row count instead of vanishing."""
    df = spark.createDataFrame([("a", 1.0, 5), ("b", 2.0, 5)], "k string, v double, x int")
    spec = MetricSpec("m", (("k", "k"),), (Measure("total", (Term("v"),)),), (Predicate("x", "=", "5"),))
    matrix = scoring.kill_matrix(spec, df, [Suite("s", [A.RowCount("some rows", 1)])])
    rows = rows_by(matrix, "operator")
    assert rows["BOUNDARY_SHIFT"]["variant_rows"] == 0
    assert rows["BOUNDARY_SHIFT"]["assertions_failed"] == ["some rows"]
    assert rows["FILTER_DROP"]["classification"] == scoring.EQUIVALENT


def test_kill_matrix_reports_runtime_errors(spark):
    df = table(spark, "monthly_active_users")
    matrix = scoring.kill_matrix(CORPUS["monthly_active_users"], df, [Suite("s", [A.RowCount("rows", 1)])])
    assert rows_by(matrix, "operator")["AGGREGATION_SWAP"]["classification"] == scoring.RUNTIME_ERROR


def test_total_compare_overlooks_what_strict_sees(spark):
    """Take rates of two sellers swap: the total stays, the rows do not."""
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 1.0)], "k string, v double, w double")
    spec = MetricSpec("m", (("k", "k"),), (Measure("net", (Term("v"), Term("w", sign=-1))),))
    strict = rows_by(scoring.kill_matrix(spec, df, [Suite("s", [A.RowCount()])]), "operator")
    lax = rows_by(scoring.kill_matrix(spec, df, [Suite("s", [A.RowCount()])], strict=False), "operator")
    assert not strict["MATH_OPERATOR_INVERT"]["equivalent"]
    assert lax["AGGREGATION_SWAP"]["equivalent"]
