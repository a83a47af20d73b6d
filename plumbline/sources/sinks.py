"""Writers: redacted JSON lines, content-addressed artifacts, matrices and findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import text_hash
from plumbline.operators.drift import finding_level, rule_catalogue
from plumbline.session import path_exists


def redacted(rows: DataFrame, raw: Sequence[str] = ("final_sql_raw",)) -> DataFrame:
    """The rows without their raw texts."""
    return rows.drop(*raw)


def write_jsonl(rows: DataFrame, path: str, raw: Sequence[str] = ("final_sql_raw",), mode: str = "errorifexists") -> None:
    redacted(rows, raw).write.mode(mode).json(path)


def artifacts(rows: DataFrame, column: str) -> DataFrame:
    """Content-addressed store: one row per distinct text, keyed by its hash.

    Texts are keyed by their short hash before they are moved.
    """
    keyed = rows.where(F.col(column).isNotNull()).select(text_hash(F.col(column)).alias("sql_hash"), F.trim(column).alias("sql"))
    return keyed.dropDuplicates(["sql_hash"])


def write_artifacts(rows: DataFrame, column: str, path: str) -> None:
    """Append the texts that the store does not hold yet."""
    fresh = artifacts(rows, column)
    spark = rows.sparkSession
    if path_exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select("sql_hash"), "sql_hash", "left_anti")
    fresh.write.mode("append").parquet(path)


def write_matrix(evaluations: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    evaluations.write.mode(mode).format(fmt).save(path)


def findings_report(findings: DataFrame, message: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings with their report level, and the catalogue of rules that occur."""
    text = message if message is not None else F.format_string("[%s] %s", "severity", "drift_type")
    rows = findings.withColumns({"level": finding_level(F.col("severity")), "message": text})
    return rows, rule_catalogue(findings)


def write_findings(findings: DataFrame, path: str, message: Column | None = None) -> None:
    """Findings and rule catalogue as JSON lines, in a folder each."""
    rows, rules = findings_report(findings, message)
    rows.write.json(f"{path}/findings")
    rules.write.json(f"{path}/rules")


def write_pairs(formatted: DataFrame, split: Column, path: str, only: str | None = None, mode: str = "overwrite") -> None:
    """JSON lines, one folder per split."""
    rows = formatted.withColumn("split", split)
    if only is not None:
        rows = rows.where(F.col("split") == only)
    rows.write.mode(mode).partitionBy("split").json(path)
