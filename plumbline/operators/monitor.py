"""Probes that run on and on: only new or changed partitions of a table are scanned.

A probe is a ratio of two counts, and counts add up.  So they are kept per partition of the
watched table, together with a stamp of the partition's files, and any slice is summed from
them.  One store serves one list of probes; another list (a new contract version) starts anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.fused import FusedCheck, run_fused
from plumbline.operators.probes import Probe
from plumbline.session import path_exists


class ProbeMonitor:
    """Counts of ``probes`` per value of the partition column ``part``, below ``path``.

    Every refresh writes a new generation of the counts (probes times partitions, small next
    to the table); a generation is read once it is whole, so a refresh that died leaves the
    one before.  Refreshes of one store must not run side by side.
    """

    def __init__(self, spark: SparkSession, path: str, probes: Sequence[Probe], part: str):
        self.spark, self.probes, self.part = spark, list(probes), part
        version = hashlib.sha256(repr(self.probes).encode()).hexdigest()[:16]
        self.path = f"{path}/{version}"

    def _generations(self) -> tuple[int, int]:
        """The last whole generation (0 for none) and the first free number."""
        whole, free = 0, 1
        while path_exists(self.spark, f"{self.path}/{free}"):
            if path_exists(self.spark, f"{self.path}/{free}/_SUCCESS"):
                whole = free
            free += 1
        return whole, free

    def counts(self) -> DataFrame | None:
        """Rows (part, stamp, probe, matches, total) of the last generation."""
        last, _ = self._generations()
        return self.spark.read.parquet(f"{self.path}/{last}") if last else None

    def refresh(self, table: DataFrame) -> list:
        """Brings the counts up to the table and returns the partitions it had to scan.

        ``table`` is read from files partitioned by ``part``.  A partition has changed when the
        names, sizes or times of its files have; partitions that are gone are dropped.
        """
        file = F.struct("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("file")
        files = table.select(F.col(self.part), file).distinct()  # reads no column of the files
        stamp = F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(F.xxhash64("file"))).alias("stamp")
        stamps = files.groupBy(self.part).agg(stamp)
        before = self.counts()

        def same(left, right):
            return left[self.part].eqNullSafe(right[self.part]) & (left["stamp"] == right["stamp"])

        if before is None:
            changed, kept = [tuple(r) for r in stamps.collect()], None
        else:
            known = before.select(self.part, "stamp").distinct()
            changed = [tuple(r) for r in stamps.join(known, same(stamps, known), "left_anti").collect()]
            kept = before.join(stamps, same(before, stamps), "left_semi")
            if not changed and known.count() == stamps.count():
                return []
        found = self._counted(table, changed, stamps.schema)
        (found if kept is None else kept.unionByName(found)).write.parquet(f"{self.path}/{self._generations()[1]}")
        return [value for value, _ in changed]

    def _counted(self, table: DataFrame, changed: list[tuple], schema) -> DataFrame:
        values = [value for value, _ in changed if value is not None]
        wanted = F.col(self.part).isin(values)
        if len(values) < len(changed):
            wanted = wanted | F.col(self.part).isNull()
        checks = []
        for i, probe in enumerate(self.probes):
            checks.append(FusedCheck(probe.check().aggregates, lambda pick, i=i: F.struct(F.lit(i).alias("probe"), pick("matches").alias("matches"), pick("total").alias("total"))))
        found = run_fused(table.where(wanted), checks, [self.part])
        marks = self.spark.createDataFrame(changed, schema)
        return found.join(marks, found[self.part].eqNullSafe(marks[self.part])).select(found[self.part], "stamp", "probe", "matches", "total")

    def results(self, by: Sequence[str] = ()) -> DataFrame:
        """What ``run_probes`` gives on the table as of the last refresh, from the counts alone."""
        held = self.counts()
        if held is None:
            raise ValueError(f"no counts below {self.path}; refresh first")
        checks = []
        for i, probe in enumerate(self.probes):

            def total(name: str, i=i) -> Column:
                return F.coalesce(F.sum(F.when(F.col("probe") == i, F.col(name))), F.lit(0).cast("bigint"))

            checks.append(FusedCheck({"matches": total("matches"), "total": total("total")}, probe.check().row))
        return run_fused(held, checks, by)
