"""Many checks, one scan.

Each check contributes aggregate columns; all of them are evaluated in a single
global aggregate and the one-row result is turned into one row per check.
Checks are taken in chunks so the generated code stays inside one method.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 100


@dataclass(frozen=True)
class FusedCheck:
    """``aggregates`` by local name, and the row built from their results."""

    aggregates: dict[str, Column]
    row: Callable[[Callable[[str], Column]], Column]


def run_fused(df: DataFrame, checks: Sequence[FusedCheck], by: Sequence[str] = ()) -> DataFrame:
    """One row per check (and per value of ``by``), in one aggregate per chunk."""
    if not checks:
        raise ValueError("no checks to run")
    parts = []
    for start in range(0, len(checks), CHUNK):
        aggregates, rows = [], []
        for i, check in enumerate(checks[start : start + CHUNK]):
            prefix = f"__c{i}_"
            aggregates += [column.alias(prefix + name) for name, column in check.aggregates.items()]
            rows.append(check.row(lambda name, prefix=prefix: F.col(prefix + name)))
        totals = df.groupBy(*by).agg(*aggregates)
        parts.append(totals.select(*by, F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)
