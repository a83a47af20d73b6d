"""Checks that business metrics still mean what their owners agreed, as Spark jobs.

Every public call takes DataFrames and returns lazy DataFrames.  Nothing is
collected to the driver and nothing holds rows outside Spark.
"""

from plumbline.plans.spec import Measure, MetricSpec, Predicate, Ratio, Term

__all__ = ["Measure", "MetricSpec", "Predicate", "Ratio", "Term"]
__version__ = "0.1.0"
