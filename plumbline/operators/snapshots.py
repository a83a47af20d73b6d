"""Snapshots of source tables by metric and time, for replaying what a query saw.

A snapshot of a table is a partition of one Parquet folder, so reading one prunes
the others.  The registry next to them says which snapshots a metric has and when
they were taken: a few rows for each metric, written once per snapshot.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ENTRY = "metric_id string, snapshot_id string, taken_at timestamp, tables array<string>"


class SnapshotRegistry:
    """Snapshots below ``root``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, snapshot_id: str, tables: Mapping[str, DataFrame]) -> None:
        """The tables as they are now, under one name; a name is written once."""
        for name, df in tables.items():
            df.withColumn("snapshot_id", F.lit(snapshot_id)).write.partitionBy("snapshot_id").mode("append").parquet(f"{self.root}/tables/{name}")

    def register(self, metrics: Mapping[str, Sequence[str]], snapshot_id: str, taken_at: dt.datetime) -> None:
        """``metrics``: the tables of each metric that reads this snapshot."""
        rows = [(metric, snapshot_id, taken_at, list(tables)) for metric, tables in metrics.items()]
        self.spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").parquet(f"{self.root}/registry")

    def entries(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{self.root}/registry")

    def load(self, table: str, snapshot_id: str) -> DataFrame:
        """One snapshot of a table; only its partition is read."""
        return self.spark.read.parquet(f"{self.root}/tables/{table}").where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")

    def resolve(self, traces: DataFrame, at: str = "ts", metric: str = "metric_id") -> DataFrame:
        """Adds ``snapshot_id``: the metric's latest snapshot taken no later than the trace; NULL without one.

        Of snapshots taken at the same time the largest name counts.  Each entry holds
        until the next one, so a trace meets its metric's entries and keeps one.
        """
        last = self.entries().groupBy(F.col("metric_id").alias("__m"), F.col("taken_at").alias("__from")).agg(F.max("snapshot_id").alias("snapshot_id"))
        spans = last.withColumn("__to", F.lead("__from").over(W.partitionBy("__m").orderBy("__from")))
        time = F.col(at).cast("timestamp")
        held = (F.col(metric) == F.col("__m")) & (time >= F.col("__from")) & (F.col("__to").isNull() | (time < F.col("__to")))
        return traces.join(spans, held, "left").drop("__m", "__from", "__to")

    def tables_of(self, metric_id: str, snapshot_id: str) -> dict[str, DataFrame]:
        own = self.entries().where((F.col("metric_id") == metric_id) & (F.col("snapshot_id") == snapshot_id))
        names = sorted({name for r in own.collect() for name in r["tables"]})
        return {name: self.load(name, snapshot_id) for name in names}
