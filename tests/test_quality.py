import math

import pytest
from pyspark.sql import functions as F
from tables import first, rows_by

from plumbline.operators import assertions as A
from plumbline.operators import compare
from plumbline.operators import probes as P
from plumbline.operators.contrast import Roles, contrast_score, profile_contrast
from plumbline.operators.percentiles import exact_percentiles
from plumbline.operators.suites import (
    Suite,
    classify_schema_tests,
    project_suite,
    run_suite,
    semantic_suite,
    structural_suite,
    suite_from_schema_tests,
    suite_verdict,
)


def run(df, *checks, tables=None, by=()):
    return rows_by(run_suite(df, Suite("s", list(checks)), tables, by), "name")


# --- assertions -------------------------------------------------------------------------------


def test_not_null_counts_rows_and_cells(spark):
    df = spark.createDataFrame([(None, None), (1, None), (1, 2)], "a int, b int")
    row = run(df, A.NotNull("n", ("a", "b")))["n"]
    assert (row["passed"], row["violations"], row["observed"]) == (False, 2, 3.0)
    assert row["reason"]


def test_unique_takes_null_keys_as_equal(spark):
    df = spark.createDataFrame([(None,), (None,), (1,), (1,), (1,), (2,)], "a int")
    row = run(df, A.Unique("u", ("a",)))["u"]
    assert (row["violations"], row["observed"]) == (2, 3.0)


def test_range_and_values_ignore_null(spark):
    df = spark.createDataFrame([(None, None), (1.0, "x"), (5.0, "y")], "v double, s string")
    rows = run(
        df,
        A.AcceptedRange("incl", "v", 1, 5),
        A.AcceptedRange("strict", "v", 1, 5, False),
        A.AcceptedRange("open", "v"),
        A.AcceptedValues("vals", "s", ("x",)),
        A.AcceptedValues("none", "s", ()),
    )
    assert {n: r["violations"] for n, r in rows.items()} == {"incl": 0, "strict": 2, "open": 0, "vals": 1, "none": 2}


def test_missing_columns_and_tables_are_skipped(spark):
    df = spark.createDataFrame([(1,)], "a int")
    rows = run(df, A.AcceptedRange("gone", "zzz", 0), A.Relationships("fk", "a", "nowhere", "id"), A.Unique("u", ("q",)))
    assert all(r["passed"] and r["skipped"] for r in rows.values())


def test_relationships(spark):
    parents = spark.createDataFrame([("CUST_1", "n"), ("CUST_2", "m")], "customer_id string, name string")
    child = spark.createDataFrame([("CUST_1",), ("CUST_UNKNOWN",), ("CUST_UNKNOWN",), (None,)], "customer_id string")
    row = run(child, A.Relationships("fk", "customer_id", "customers", "customer_id"), tables={"customers": parents})["fk"]
    assert (row["violations"], row["observed"]) == (2, 1.0)


def test_population_counts_pairs_and_entities(spark):
    source = spark.createDataFrame(
        [("c1", "active"), ("c1", "closed"), ("c1", "closed"), ("c2", None), ("c3", "active")], "customer_id string, status string"
    )
    target = spark.createDataFrame([("c1",), ("c1",), ("c2",), ("c3",), (None,)], "customer_id string")
    row = run(target, A.Population("p", "src", "status = 'active'"), tables={"src": source})["p"]
    # two output rows of c1 meet two closed source rows; a NULL status is no breach
    assert (row["violations"], row["observed"]) == (4, 1.0)


def test_metric_value_tolerances(spark):
    df = spark.createDataFrame([(2940.0,)], "v double")
    rows = run(
        df,
        A.MetricValue("wide", "v", expected=2800.0, tolerance_pct=5.0),
        A.MetricValue("tight", "v", expected=2800.0),
        A.MetricValue("zero", "v", expected=0),
        A.MetricValue("bounds", "v", min_value=0, max_value=2939),
    )
    assert {n: r["passed"] for n, r in rows.items()} == {"wide": True, "tight": False, "zero": False, "bounds": False}
    empty = run(df.limit(0), A.MetricValue("zero", "v", expected=0))
    assert empty["zero"]["passed"] and empty["zero"]["observed"] == 0.0


def test_singular_and_custom(spark):
    model = spark.createDataFrame([("O1", 100.0), ("O1", -20.0)], "order_id string, amount double")
    sql = "SELECT order_id FROM {{ model }} GROUP BY 1 HAVING NOT (SUM(amount) >= 0)"
    negative = spark.createDataFrame([("O1", -20.0)], "order_id string, amount double")
    assert run(model, A.Singular("s", sql))["s"]["passed"]
    assert not run(negative, A.Singular("s", sql))["s"]["passed"]
    assert run(model, A.Custom("c", lambda df: df.where("amount < 0")))["c"]["violations"] == 1
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("singular_")]


def test_non_negative_covers_all_numeric_columns(spark):
    df = spark.createDataFrame([(1, -1.0, "x"), (-1, -1.0, "x"), (None, 1.0, "x")], "a int, b double, s string")
    row = run(df, A.NonNegative("n"))["n"]
    assert (row["violations"], row["observed"]) == (2, 3.0)


def test_sliced_suite(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), ("y", 1), ("y", None)], "g string, a int")
    results = run_suite(df, Suite("s", [A.NotNull("n", ("a",)), A.Unique("u", ("a",))]), by=["g"]).collect()
    assert {(r["g"], r["name"]): r["violations"] for r in results} == {
        ("x", "n"): 0, ("y", "n"): 1, ("x", "u"): 1, ("y", "u"): 0,
    }


def test_more_assertions_than_one_chunk(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    results = run_suite(df, Suite("s", [A.NotNull(f"n{i}", ("a",)) for i in range(230)]))
    assert results.count() == 230 and results.where("violations = 1").count() == 230


def test_suite_from_declarations():
    suite = Suite.from_yaml_text(
        """
        suite_name: s
        assertions:
          - {type: non_null, columns: [a]}
          - {type: Unique_Key, columns: [a]}
          - {type: row_count_bounds, min_rows: 0, max_rows: 5}
          - {type: dbt_utils.accepted_range, column: a, min_value: 0}
          - {type: domain, column: a, values: [1, 2], quote: false}
          - {type: foreign_key, column: a, to_table: p, field: id}
          - {type: singular_sql, name: q, sql: SELECT 1}
          - {type: required_filter, required_filter: "x = 1"}
          - {type: expected_value, expected: 0, tolerance_pct: 2.5}
          - {type: expected_grain, grain_columns: [a, b]}
          - {type: unheard_of}
        """
    )
    kinds = [a.kind for a in suite.assertions]
    assert kinds == [
        "not_null", "unique", "row_count", "accepted_range", "accepted_values", "relationships",
        "singular_sql_test", "population", "metric_value", "grain",
    ]
    value = suite.assertions[8]
    assert value.expected == 0 and value.tolerance_pct == 2.5
    assert suite.assertions[2].min_rows == 0


def test_default_suites(spark):
    net = spark.createDataFrame([("C1", "2026-01", 3000.0)], "customer_id string, reporting_month string, net_revenue double")
    tx = spark.createDataFrame([("C2", "pending", "NA")], "customer_id string, status string, region string")
    verdicts = rows_by(
        suite_verdict(
            run_suite(net, structural_suite()).unionByName(run_suite(net, semantic_suite(), {"transactions": tx}))
        ),
        "suite",
    )
    assert verdicts["structural"]["all_passed"] and verdicts["semantic"]["all_passed"]
    assert len(project_suite().assertions) == 7


def test_schema_tests(spark):
    tests = spark.createDataFrame(
        [("m", "id", "not_null"), ("m", "id", "recency"), ("m", None, "equal_rowcount"), ("m", "id", "unique")],
        "model string, column_name string, test string",
    )
    row = first(classify_schema_tests(tests))
    assert (row["declared_tests"], row["supported_tests"], row["skipped_tests"]) == (4, 2, 2)
    assert row["skipped_names"] == ["id.recency", "model_test.equal_rowcount"]
    suite = suite_from_schema_tests(
        "m",
        [
            {"column": "id", "test": "relationships", "args": {"to": "ref('customers')", "field": "cid"}},
            {"column": "id", "test": "recency"},
            {"test": "dbt_utils.unique_combination_of_columns", "args": {"combination_of_columns": ["a", "b"]}},
        ],
    )
    assert suite.assertions[0].to_table == "customers" and suite.assertions[1].columns == ("a", "b")
    assert suite_from_schema_tests("m", []).assertions[0].kind == "row_count"


# --- probes -----------------------------------------------------------------------------------


def probe_table(spark):
    rows = [("a", "active", 100.0)] * 10 + [("b", "churned", 0.0)] * 90
    return spark.createDataFrame(rows, "customer_id string, status string, mrr_amount double")


def test_population_probe(spark):
    df = probe_table(spark)
    fine = first(P.run_probes(df, [P.PopulationProbe("m", "status", "active", 0.10)]))
    off = first(P.run_probes(df, [P.PopulationProbe("m", "status", "active", 0.80)]))
    assert not fine["alert"] and fine["confidence"] is None and fine["likely_causes"] is None
    assert off["alert"] and off["confidence"] == "high" and off["relative_change"] == -87.5
    assert off["signal_type"] == "status_population_rate_shift" and len(off["likely_causes"]) == 3


def test_implication_probe(spark):
    df = probe_table(spark)
    kept = P.ImplicationProbe("m", "status", "active", "mrr_amount", ">", 0, 1.0)
    lost = P.ImplicationProbe("m", "status", "churned", "mrr_amount", ">", 0, 0.9)
    rows = rows_by(P.run_probes(df, [kept, lost]), "baseline")
    assert not rows[1.0]["alert"] and rows[1.0]["current"] == 1.0
    assert rows[0.9]["alert"] and rows[0.9]["relative_change"] == -100.0


def test_null_probe_and_empty_table(spark):
    df = spark.createDataFrame([(None,), (1,), (2,), (3,)], "c int")
    row = first(P.run_probes(df, [P.NullDriftProbe("m", "c")]))
    assert row["alert"] and row["current"] == 0.25 and row["relative_change"] == 0.0 and row["confidence"] == "medium"
    empty = first(P.run_probes(df.limit(0), [P.NullDriftProbe("m", "c")]))
    assert empty["current"] == 0.0 and not empty["alert"]


def test_both_probe_grammars(spark):
    contract = {
        "metric": "m",
        "probes": {
            "population": [
                {"column": "status", "target_value": "active", "baseline_rate": 0.5},
                {"predicate": "status = 'active'", "min_rate": 0.05, "max_rate": 0.2},
            ],
            "implications": [{"antecedent": "status = 'active'", "consequent": "mrr_amount > 100", "min_confidence": 0.9}],
            "null_drift": [{"column": "status", "max_null_rate": 0.0}],
        },
    }
    results = P.run_probes(probe_table(spark), P.probes_from_contract(contract)).collect()
    assert [r["alert"] for r in results] == [True, False, True, False]


# --- contrast ---------------------------------------------------------------------------------


def test_contrast(spark):
    good = spark.createDataFrame(
        [("C1", "active", "NA", 10.0), ("C1", "churned", "EU", 20.0), ("C2", "active", "APAC", 5.0), ("C3", "active", "NA", 1.0)],
        "customer_id string, status string, region string, amount double",
    )
    score = first(contrast_score(profile_contrast(good)))
    assert score["score_pct"] >= 70 and score["adequate"]
    bad = spark.createDataFrame([("active",), ("active",)], "status string")
    checks = rows_by(profile_contrast(bad), "check_name")
    assert checks["status"]["status"] == "FAIL" and checks["volume"]["status"] == "WARN"


def test_null_is_a_category(spark):
    df = spark.createDataFrame([("x",), (None,), ("x",)], "region string")
    checks = rows_by(profile_contrast(df, Roles(categories=("region",))), "check_name")
    assert checks["category_region"]["status"] == "PASS"
    empty = rows_by(profile_contrast(df.limit(0), Roles(categories=("region",), key="region")), "check_name")
    assert empty["category_region"]["status"] == "WARN" and empty["grain_region"]["status"] == "WARN"


# --- comparison -------------------------------------------------------------------------------


def test_multiset(spark):
    schema = "id int, status string, val double"
    a = spark.createDataFrame([(1, "x", 1.0), (None, None, 2.0), (1, "x", 1.0)], schema)
    b = spark.createDataFrame([(2.00001, None, None), (1.0, 1, " x "), (1.00004, 1, "x")], "val double, id int, status string")
    assert first(compare.multiset_difference(a, b))["equal"]
    assert not first(compare.strict_difference(a, b))["equal"]
    once = spark.createDataFrame([(1, "x", 1.0), (None, None, 2.0)], schema)
    assert first(compare.multiset_difference(a, once)) == {"only_base": 1, "only_other": 0, "equal": False}
    assert first(compare.multiset_difference(a.limit(0), a.limit(0)))["equal"]
    assert not first(compare.multiset_difference(a.limit(0), a))["equal"]
    assert not first(compare.multiset_difference(a, a.drop("val")))["equal"]


def test_variance(spark):
    a = spark.createDataFrame([("x", 10.0), ("y", 20.0)], "k string, v double")
    swapped = spark.createDataFrame([("x", 20.0), ("y", 10.0)], "k string, v double")
    more = spark.createDataFrame([("x", 10.0)], "k string, v double")
    assert first(compare.variance(a, swapped))["equal"]
    row = first(compare.variance(a, more))
    assert (row["row_delta"], row["variance_pct"], row["equal"]) == (-1, 50.0, False)
    text = spark.createDataFrame([("x",), ("y",)], "k string")
    other = spark.createDataFrame([("x",), ("z",)], "k string")
    assert first(compare.variance(text, text))["equal"] and not first(compare.variance(text, other))["equal"]
    changes = rows_by(compare.cellwise(a, swapped, ["k"], ["v"]), "k")
    assert {k: r["change"] for k, r in changes.items()} == {"x": "changed", "y": "changed"}


def test_fingerprint_ignores_order_but_not_multiplicity(spark):
    df = spark.range(100).selectExpr("id", "cast(id as string) s")
    same = df.repartition(7).orderBy("s")
    prints = [first(compare.fingerprint(x))["fingerprint"] for x in (df, same, df.union(df.limit(1)))]
    assert prints[0] == prints[1] != prints[2]


def shuffled_rows(frame):
    """Rows written by the exchanges left in a finished plan; what an empty set of buckets makes needless is gone from it."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    todo, rows = [plan], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
        if name == "Exchange":
            rows += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows


def test_tree_comparison_shuffles_fingerprints_of_equal_tables(spark):
    a = spark.range(0, 60000, 1, 2).selectExpr("id", "cast(id % 7 as string) s", "if(id % 5 = 0, null, id / 3) v")
    tree, flat = compare.tree_difference(a, a.orderBy("v")), compare.multiset_difference(a, a)
    assert first(tree) == {"only_base": 0, "only_other": 0, "equal": True}
    assert shuffled_rows(tree) <= 4 * 4096 and shuffled_rows(compare.tree_cellwise(a, a, ["id"], ["v"])) <= 4 * 4096
    assert shuffled_rows(flat) >= 120000
    changed = a.withColumn("v", F.expr("if(id = 11, 0.5D, v)"))
    assert first(compare.tree_difference(a, changed)) == first(compare.multiset_difference(a, changed))
    want = compare.cellwise(a, changed, ["id"], ["v"]).where("change <> 'same'").collect()
    assert compare.tree_cellwise(a, changed, ["id"], ["v"]).collect() == want and len(want) == 1
    bucketed = [compare._bucketed(df, [F.col("id")], [F.col(c) for c in df.columns]) for df in (a, changed)]
    assert sum(df.count() for df in compare._unequal_part(*bucketed)) < 20


def test_tree_comparison_agrees_with_the_flat_one(spark):
    schema = "id int, status string, val double"
    rows = [(1, "x", 1.0), (None, None, 2.0), (1, "x", 1.0), (None, "x", None), (3, "a ", 0.0), (4, None, None)]
    a = spark.createDataFrame(rows, schema)
    others = [rows[:-1], rows + rows[:1], [(1, None, 1.0), *rows[1:]], [(1, "x", 1.00004), *rows[1:4], (3, "a", -0.0), rows[5]], []]
    for other in others:
        b = spark.createDataFrame(other, schema)
        assert first(compare.tree_difference(a, b)) == first(compare.multiset_difference(a, b))
        assert first(compare.tree_difference(a, b, None)) == first(compare.strict_difference(a, b))
    assert not first(compare.tree_difference(a, a.drop("val")))["equal"]
    # NULL and a value that changed places
    left, right = spark.sql("SELECT 1 AS k, CAST(NULL AS STRING) AS p, 'v' AS q"), spark.sql("SELECT 1 AS k, 'v' AS p, CAST(NULL AS STRING) AS q")
    assert first(compare.tree_cellwise(left, right, ["k"], ["p", "q"]))["change"] == "changed"
    assert first(compare.tree_difference(left, right)) == {"only_base": 1, "only_other": 1, "equal": False}
    twice = a.where("id = 1")
    assert compare.tree_cellwise(twice, twice, ["id"], ["val"]).isEmpty()
    assert first(compare.tree_cellwise(twice, twice.limit(1), ["id"], ["val"]))["change"] == "repeated"


# --- percentiles ------------------------------------------------------------------------------


def test_percentiles_match_the_built_in_aggregate(spark):
    """One group holds most rows; values of all magnitudes, repeated and distinct."""
    df = spark.range(20000).selectExpr(
        "case when id % 10 < 7 then 'hot' when id % 10 = 9 then null else 'cold' end g",
        "cast(case when id % 3 = 0 then 7 when id % 11 = 0 then -exp(id / 1000) when id % 13 = 0 then pow(10, id % 600 - 300) "
        "else pmod(id * 7919, 10007) / 4 end as double) v",
    )
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    built_in = df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, wanted.values()))).alias("p"))
    want = {r["g"]: r["p"] for r in built_in.collect()}
    got = {r["g"]: r.asDict() for r in exact_percentiles(df, "v", wanted, ["g"]).collect()}
    assert want.keys() == got.keys() == {"hot", "cold", None}
    for group, values in want.items():
        assert [got[group][p] for p in wanted] == pytest.approx(values, rel=1e-12)
    one = first(exact_percentiles(spark.createDataFrame([(4.0,)], "v double"), "v", {"p": 0.95}))
    assert one["p"] == 4.0
    close = spark.range(3000).selectExpr("1 + id * pow(2D, -52) as v")
    assert first(exact_percentiles(close, "v", {"p": 0.5}))["p"] == pytest.approx(1 + 1499.5 * 2**-52, rel=1e-16)
    assert exact_percentiles(df.limit(0), "v", {"p": 0.5}).count() == 0


def test_integers_and_decimals_are_compared_exactly(spark):
    big = spark.sql("SELECT 9007199254740993L AS v, 'k' AS k")
    less = spark.sql("SELECT 9007199254740992L AS v, 'k' AS k")
    wide = spark.sql("SELECT CAST(9007199254740993 AS DECIMAL(30,0)) AS v, 'k' AS k")
    assert not first(compare.strict_difference(big, less))["equal"] and not first(compare.multiset_difference(big, less))["equal"]
    assert first(compare.strict_difference(big, wide))["equal"]
    assert first(compare.cellwise(big, less, ["k"], ["v"]))["change"] == "changed"
    repeated = first(compare.cellwise(big, less.union(less), ["k"], ["v"]))
    assert (repeated["change"], repeated["rows_base"], repeated["rows_other"]) == ("repeated", 1, 2)
    assert first(compare.fingerprint(big))["fingerprint"] != first(compare.fingerprint(less))["fingerprint"]


def test_percentile_cells_keep_the_order_and_stay_small(spark):
    from plumbline.operators.percentiles import _cell

    edges = [0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 1e-300, 2e-13, 0.1, 0.5, 1.0, 1.5, 2.0, 1e300, 1.7976931348623157e308, float("inf")]
    near = [math.nextafter(2.0**k, way) for k in range(-1070, 1024, 9) for way in (0.0, math.inf)] + [2.0**k for k in range(-1074, 1024, 7)]
    values = sorted({s * v for v in edges + near for s in (-1, 1)})
    found = spark.createDataFrame([(v,) for v in [*values, float("nan")]], "v double").select("v", _cell(F.col("v")).alias("c")).orderBy("v").collect()
    numbers = [r["c"] for r in found]
    assert numbers == sorted(numbers) and numbers[0] >= 0 and numbers[-1] < 2**48 and numbers[-1] > numbers[-2]
    small = spark.range(100_000).select(((F.col("id") + 1) * 1e-17).alias("v"))
    cells = small.select(_cell(F.col("v")).alias("c")).groupBy("c").count()
    assert cells.agg(F.max("count")).first()[0] <= 4 and cells.count() > 90_000
    got = first(exact_percentiles(small, "v", {"p": 0.25, "q": 0.999}))
    assert got["p"] == pytest.approx(25_000.75e-17, rel=1e-12) and got["q"] == pytest.approx(99_900.001e-17, rel=1e-12)


def test_percentiles_of_null_groups_and_columns_without_values(spark):
    rows = [(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    assert {r["g"]: r["p"] for r in exact_percentiles(df, "v", {"p": 0.5}, ["g"]).collect()} == {None: 2.0, "a": 2.0}
    assert exact_percentiles(df.where("g = 'b'"), "v", {"p": 0.5}).count() == 0


def test_fingerprints_tell_separators_and_nulls_apart(spark):
    rows = [[("a\x1fb", "c")], [("a", "b\x1fc")], [(None, "c")], [("\x00", "c")], [("-", "c")], [("1:a", "c")], [("a", None)], [("a", "")], [("", "a")]]
    prints = [first(compare.fingerprint(spark.createDataFrame(r, "x string, y string")))["fingerprint"] for r in rows]
    assert len(set(prints)) == len(rows)
    both = spark.createDataFrame(rows[0] + rows[2], "x string, y string")
    assert first(compare.fingerprint(both)) == first(compare.fingerprint(both.repartition(3).select("y", "x")))
