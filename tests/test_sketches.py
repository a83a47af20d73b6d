"""Stored daily sketches against exact values."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import sketches as S


def test_months_are_merged_from_days_within_the_stated_errors(spark, tmp_path):
    df = spark.range(60000).selectExpr(
        "date_add(DATE'2024-01-01', cast(id % 45 as int)) AS ts", "if(id % 3 = 0, 'hot', null) AS slice", "id % 9000 AS user", "cast(pmod(id * 7919, 60000) as double) AS v"
    )
    path = str(tmp_path / "days")
    S.store_days(S.daily_sketches(df, F.col("ts"), ["slice"], {"user": F.col("user")}, {"v": F.col("v")}), path)
    days = S.stored_days(spark, path)
    assert days.count() == 45  # ids of a day share their slice
    row = S.merged(days, (), {"p50": 0.5, "p99": 0.99}).first()
    assert row["rows"] == 60000 and row["distinct_user"] == pytest.approx(9000, rel=3 * S.DISTINCT_ERROR)
    assert row["values_v_p50"] == pytest.approx(30000, abs=60000 * S.QUANTILE_ERROR)
    assert row["values_v_p99"] == pytest.approx(59400, abs=60000 * S.QUANTILE_ERROR)
    months = {r["m"]: r["distinct_user"] for r in S.merged(days, [F.month("day").alias("m")]).collect()}
    want = {r["m"]: r["n"] for r in df.groupBy(F.month("ts").alias("m")).agg(F.count_distinct("user").alias("n")).collect()}
    assert months.keys() == want.keys() and all(months[m] == pytest.approx(n, rel=3 * S.DISTINCT_ERROR) for m, n in want.items())


def test_a_corrected_day_replaces_its_partition_alone(spark, tmp_path):
    path = str(tmp_path / "days")

    def sketched(rows):
        return S.daily_sketches(spark.createDataFrame(rows, "ts string, u string, v double"), F.col("ts"), (), {"u": F.col("u")}, {"v": F.col("v")})

    S.store_days(sketched([("2024-01-01", "a", 1.0), ("2024-01-02", "b", 5.0), ("2024-01-02", None, float("nan"))]), path)
    S.store_days(sketched([("2024-01-02", "c", 7.0), ("2024-01-02", "d", None), ("2024-01-03", None, None)]), path)
    got = {str(r["day"]): (r["rows"], r["distinct_u"], r["values_v_max"]) for r in S.merged(S.stored_days(spark, path), ["day"], {"max": 1.0}).collect()}
    assert got == {"2024-01-01": (1, 1, 1.0), "2024-01-02": (2, 2, 7.0), "2024-01-03": (1, 0, None)}
    assert S.merged(S.stored_days(spark, path).limit(0), ["day"], {"max": 1.0}).isEmpty()
