"""Contract documents, JSON logs and project manifests."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTRACT_SCHEMA = (
    "metric string, urn string, version string, description string, owner string, grain string, sql string, "
    "dialect string, tags array<string>, dimensions array<string>, "
    "invariants struct<"
    "population:struct<required_filters:array<string>,forbidden_filters:array<string>>,"
    "grain:struct<required_dimensions:array<string>,allow_over_aggregation:boolean>,"
    "aggregation:struct<required_function:string,positive_components:array<string>,negative_components:array<string>>,"
    "units:struct<currency:string,scale:string>,"
    "time:struct<timezone:string,period_grain:string>>, "
    "probes string, "
    "provenance struct<repository:string,organization:string,reference_path:string,commit_sha:string,"
    "verified_symbols:array<string>>, "
    "metadata map<string,string>"
)

TRAJECTORY_SCHEMA = (
    "scenario_id string, agent_type string, model_id string, prompt_hash string, "
    "tool_calls array<struct<tool:string,arguments_hash:string,result_summary:string,latency_ms:double>>, "
    "draft_count int, final_sql_hash string, final_sql_raw string, execution_success boolean, "
    "contract_compliant boolean, result_correct boolean, abstained boolean, appropriate_abstention boolean, "
    "ceiling_reached boolean, latency_ms double, estimated_cost_usd double, audit_chain_verified boolean"
)

TRACE_SCHEMA = (
    "trace_id string, timestamp double, agent_id string, metric_id string, contract_version string, sql string, "
    "sql_hash string, decision string, violation_count int, "
    "violations array<struct<rule:string,expected:string,found:string,severity:string,invariant_type:string,"
    "mutation_equivalent:string>>"
)

NODE = "struct<name:string,resource_type:string,compiled_code:string,raw_code:string,config:map<string,string>>"
DOCUMENT_SUFFIXES = r"\.(ya?ml|json)$"


def _contract_json(content: bytes | str) -> tuple[str | None, str | None]:
    """The document as JSON, or why it is no contract."""
    import yaml

    try:
        data = yaml.safe_load(content)
    except (yaml.YAMLError, ValueError, RecursionError) as error:
        return None, f"unreadable: {(str(error).splitlines() or [''])[0]}"
    if not isinstance(data, dict) or not data.get("metric"):
        return None, "no metric"
    shapes = {"metadata": dict, "tags": list, "dimensions": list, "invariants": dict, "provenance": dict}
    odd = sorted(name for name, shape in shapes.items() if data.get(name) is not None and not isinstance(data[name], shape))
    if odd:
        return None, f"wrong type: {', '.join(odd)}"
    data["urn"] = data.get("urn") or data.get("id")
    data["version"] = None if data.get("version") is None else str(data["version"])
    data["metadata"] = {str(k): str(v) for k, v in (data.get("metadata") or {}).items()}
    if data.get("domain"):
        data["metadata"].setdefault("domain", str(data["domain"]))
    try:
        data["probes"] = json.dumps(data.get("probes") or {}, sort_keys=True, default=str)
        return json.dumps(data, default=str), None
    except (TypeError, ValueError) as error:
        return None, f"no JSON form: {error}"


def parse_contracts(documents: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Every document with its contract (``contract``) or the reason it was refused (``reject``)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_contract_json(c) for c in batch["c"]]
            yield pd.DataFrame({"path": batch["p"], "doc": [d for d, _ in found], "reject": [r for _, r in found]})

    slim = documents.select(F.col(path).cast("string").alias("p"), F.col(content).alias("c"))
    parsed = slim.mapInPandas(parse, "path string, doc string, reject string")
    return parsed.select("path", F.from_json("doc", CONTRACT_SCHEMA).alias("contract"), "reject")


def read_contracts(spark: SparkSession, folder: str, separator: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Contracts below a folder, one per metric, and the refused documents with the reason.

    A file is one document, or holds many with ``separator`` between them (such as a line of
    ``---``), which suits large collections.  Of several documents for one metric the one with the smallest path is
    taken; the others are refused.
    """
    if separator is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        files = files.where(F.col("path").rlike(DOCUMENT_SUFFIXES))
    else:
        texts = spark.read.option("recursiveFileLookup", True).option("lineSep", separator).text(folder)
        place = F.format_string("%s#%019d", F.col("_metadata.file_path"), F.monotonically_increasing_id())
        files = texts.select(place.alias("path"), F.col("value").alias("content"))
    parsed = parse_contracts(files)
    good = parsed.where(F.col("reject").isNull()).withColumn("metric", F.col("contract.metric"))
    taken = good.groupBy("metric").agg(F.min_by("contract", "path").alias("c"), F.min("path").alias("path"))
    accepted = taken.select("c.*", "path")
    further = good.select("metric", "path").join(taken.select("metric", F.col("path").alias("first")), "metric").where("path <> first")
    rejects = parsed.where(F.col("reject").isNotNull()).select("path", "reject")
    return accepted, rejects.unionByName(further.select("path", F.lit("further document of its metric").alias("reject")))


def contract_rules(contracts: DataFrame) -> DataFrame:
    """The flat rule columns that the compliance job joins with."""
    inv = F.col("invariants")
    return contracts.select(
        F.col("metric").alias("metric_id"),
        inv["population"]["required_filters"].alias("required_filters"),
        inv["population"]["forbidden_filters"].alias("forbidden_filters"),
        inv["grain"]["required_dimensions"].alias("required_dimensions"),
        inv["aggregation"]["required_function"].alias("required_function"),
        inv["aggregation"]["positive_components"].alias("positive_components"),
        inv["aggregation"]["negative_components"].alias("negative_components"),
        F.coalesce(inv["time"]["timezone"], F.lit("UTC")).alias("timezone"),
    )


def _read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and malformed lines; blank lines are skipped."""
    with_bad = T.StructType.fromDDL(schema).add("_corrupt_record", "string")
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", with_bad, {"mode": "PERMISSIVE"}).alias("row"))
    broken = F.col("row").isNull() | F.col("row._corrupt_record").isNotNull()
    good = parsed.where(~broken).select("row.*").drop("_corrupt_record")
    return good, parsed.where(broken).select(F.col("value").alias("line"))


def read_trajectories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return _read_json_lines(spark, path, TRAJECTORY_SCHEMA)


def read_traces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return _read_json_lines(spark, path, TRACE_SCHEMA)


def manifest_nodes(documents: DataFrame, content: str = "content") -> DataFrame:
    """One row per node of every manifest document."""
    schema = f"struct<nodes:map<string,{NODE}>>"
    nodes = documents.select(F.from_json(F.col(content).cast("string"), schema).alias("m"))
    exploded = nodes.select(F.explode("m.nodes").alias("node_id", "node"))
    return exploded.select("node_id", "node.*")


def read_manifest(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Nodes of manifest files: a file is one document and so one row of one task, or (``whole=False``) has a document on each line."""
    return manifest_nodes(spark.read.text(path, wholetext=whole), "value")
