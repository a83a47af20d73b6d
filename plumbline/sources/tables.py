"""Tables: parquet by name, typed CSV, registered frames and the default literal table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import ship

# Schema and rows of the default table.
TRANSACTIONS_SCHEMA = (
    "transaction_id string, customer_id string, transaction_date timestamp, amount double, "
    "type string, status string, region string, last_login timestamp"
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def load_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in names}


def read_csv(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """CSV with a header and an explicit schema.

    Nothing is inferred: inference scans the file twice and takes keys such as
    ``T1`` for timestamps.
    """
    return spark.read.schema(schema).option("header", True).option("mode", mode).csv(path)


def register(tables: Mapping[str, DataFrame]) -> None:
    """Make frames known to SQL under their names."""
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)


def literal_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
