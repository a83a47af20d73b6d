"""Lost join conditions against a cross join of the rows."""

import pytest
from pyspark.sql import functions as F

from plumbline.plans.factorised import lost_join
from plumbline.plans.spec import Measure, MetricSpec, Predicate, Ratio, Term

LEFT = [("x", 1, 2.5, 3), ("x", 2, None, 4), ("y", 3, 1.0, None), (None, 4, -2.0, 5), ("y", 5, 0.5, 9), ("z", 6, None, None)]
RIGHT = [("p", 10, 1.5, 7), ("p", 20, None, 8), ("q", 30, -1.0, None), (None, 40, 2.0, 7), ("q", 50, 4.0, 1)]
PRODUCTS = {"f * g": ("f", "g"), "m * n": ("m", "n")}


def frames(spark, left=LEFT, right=RIGHT):
    return spark.createDataFrame(left, "a string, k int, f double, m int"), spark.createDataFrame(right, "b string, j int, g double, n int")


def measures():
    return (
        Measure("s", (Term("f * g"), Term("m"), Term("g", sign=-1))),
        Measure("whole", (Term("m * n"),)),
        Measure("gated", (Term("f * g", when="j > 15"),)),
        Measure("gated_left", (Term("f * g", when="k > 2"),)),
        Measure("c", (Term("m * n", agg="count"), Term("f", agg="count"), Term("1", agg="count"))),
        Measure("d", (Term("n", agg="count", distinct=True),)),
        Measure("w", (Term("g", agg="avg"),)),
        Measure("v", (Term("f * g", agg="avg"),)),
        Measure("lo", (Term("f", agg="min"),)),
        Measure("hi", (Term("n", agg="max"),)),
        Measure("dflt", (Term("f", default=1.0),)),
        Ratio("r", Term("f * g"), Term("n", agg="count")),
    )


def values(df):
    return sorted((tuple(None if v is None else round(float(v), 9) if not isinstance(v, str) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("dims", [(("a", "a"), ("b", "b")), (("a", "a"),), (("b2", "upper(b)"),), (("j2", "j div 20"), ("a", "a"), ("b", "b")), ()])
@pytest.mark.parametrize("filters", [(), (Predicate("k", ">", "1"), Predicate("n IS NOT NULL")), (Predicate("j", ">", "99"),)])
def test_every_aggregate_is_that_of_the_cross_join(spark, dims, filters):
    left, right = frames(spark)
    spec = MetricSpec("m", dims, measures(), filters)
    got = lost_join(spec, left, right, PRODUCTS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert values(got) == values(spec.run(left.crossJoin(right)))


@pytest.mark.parametrize("empty", ["left", "right", "both"])
@pytest.mark.parametrize("dims", [(("a", "a"), ("b", "b")), (("b", "b"),), ()])
def test_empty_sides(spark, empty, dims):
    left, right = frames(spark)
    left, right = (left.limit(0) if empty != "right" else left), (right.limit(0) if empty != "left" else right)
    spec = MetricSpec("m", dims, measures())
    assert values(lost_join(spec, left, right, PRODUCTS)) == values(spec.run(left.crossJoin(right)))


def test_large_whole_numbers_stay_exact(spark):
    left = spark.range(1000).select((F.col("id") + 10**12).alias("m"))
    right = spark.range(1000).select((F.col("id") + 10**12).alias("n"))
    spec = MetricSpec("m", (), (Measure("s", (Term("m * n"),)),))
    total = sum(i + 10**12 for i in range(1000))
    assert lost_join(spec, left, right, {"m * n": ("m", "n")}).first()["s"] == float(total * total)


def test_what_does_not_factorise_is_refused(spark):
    left, right = frames(spark)
    for term in (Term("f * g"), Term("f + g", agg="max")):
        with pytest.raises(ValueError, match="neither side"):
            lost_join(MetricSpec("m", (), (Measure("s", (term,)),)), left, right)
    with pytest.raises(ValueError, match="neither side"):
        lost_join(MetricSpec("m", (), (Measure("s", (Term("f"),)),), (Predicate("k", "=", "j"),)), left, right)
    with pytest.raises(ValueError, match="products"):
        lost_join(MetricSpec("m", (), (Measure("s", (Term("f * g", agg="max"),)),)), left, right, PRODUCTS)
