"""Each operator on the driver's tables, with the SQL that must give the same rows."""

from plumbline.demos import (  # noqa: F401
    audit,
    governance,
    metrics,
    pairs,
    quality,
    relational,
    scoring,
    streams,
    trajectories,
    variants,
)
from plumbline.demos.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
