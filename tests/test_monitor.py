"""Incremental probes against the probes of the whole table."""

import pytest

from plumbline.operators import probes as P
from plumbline.operators.monitor import ProbeMonitor

SCHEMA = "status string, mrr double, day string"
PROBES = [P.PopulationProbe("c", "status", "active", 0.5), P.ImplicationProbe("c", "status", "active", "mrr", ">", 0, 0.9), P.NullDriftProbe("c", "mrr", 0.1)]


def rows_of(frame):
    return sorted(map(str, frame.collect()))


def test_only_new_and_changed_partitions_are_scanned(spark, tmp_path):
    path = str(tmp_path / "table")
    monitor = ProbeMonitor(spark, str(tmp_path / "store"), PROBES, "day")

    def write(rows):
        frame = spark.createDataFrame(rows, SCHEMA)
        frame.write.partitionBy("day").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)

    def table():
        return spark.read.schema(SCHEMA).parquet(path)

    def agrees():
        for by in ([], ["day"]):
            assert rows_of(monitor.results(by)) == rows_of(P.run_probes(table(), PROBES, by).select(*monitor.results(by).columns))

    with pytest.raises(ValueError):
        monitor.results()
    write([("active", 1.0, "1"), ("gone", None, "1"), ("active", 0.0, "2"), (None, 2.0, None)])
    assert sorted(monitor.refresh(table()), key=str) == ["1", "2", None]
    agrees()
    assert monitor.refresh(table()) == []
    write([("active", 5.0, "2"), ("active", 6.0, "2"), ("new", None, "3")])
    assert sorted(monitor.refresh(table())) == ["2", "3"]
    agrees()
    # a partition that is gone, and a refresh that died half way
    (tmp_path / "store" / monitor.path.rsplit("/", 1)[1] / "3").mkdir()
    smaller = str(tmp_path / "smaller")
    table().where("day = '2'").write.partitionBy("day").parquet(smaller)
    assert monitor.refresh(spark.read.schema(SCHEMA).parquet(smaller)) == ["2"]
    assert monitor.counts().select("day").distinct().count() == 1 and monitor._generations() == (4, 5)
    # another contract version has its own counts
    stricter = ProbeMonitor(spark, str(tmp_path / "store"), PROBES[:1], "day")
    assert sorted(stricter.refresh(table()), key=str) == ["1", "2", "3", None]


def test_a_refresh_reads_the_files_of_changed_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(100).selectExpr("if(id % 2 = 0, 'active', 'x') status", "double(id) mrr", "string(id % 5) day").write.partitionBy("day").parquet(path)
    monitor = ProbeMonitor(spark, str(tmp_path / "store"), PROBES, "day")
    table = spark.read.schema(SCHEMA).parquet(path)
    counted = monitor._counted(table, [("3", "s")], spark.createDataFrame([("3", "s")], "day string, stamp string").schema)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "= 3)" in plan
    assert {r["probe"]: (r["matches"], r["total"]) for r in counted.collect()} == {0: (10, 20), 1: (10, 10), 2: (0, 20)}
