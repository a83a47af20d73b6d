"""Provenance: do the symbols a contract claims occur in the files it cites?"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.containment import occurrences
from plumbline.session import stored

PARSED = "n string, block struct<repository:string,organization:string,reference_path:string,commit_sha:string>, symbols array<string>, reject string"


def extract_claims(documents: DataFrame, name: str = "source_file", text: str = "text") -> DataFrame:
    """One row per document that makes a provenance claim: in a block, else in comment headers.

    Documents without either marker are dropped before they reach Python; headers
    are read without it.  ``refused_claims`` has the documents whose parts have another
    type than a claim's.
    """
    found = _parsed(documents, name, text).where("reject IS NULL")
    in_block = F.col("block.repository").isNotNull()
    headers = {f: F.nullif(F.trim(F.regexp_extract("t", rf"#[ \t]*{f}:[ \t]*({value})", 1)), F.lit("")) for f, value in (("Repository", r"\S+"), ("Organization", ".+"), ("Reference", ".+"))}
    marked = F.contains("t", F.lit("# Provenance:"))

    def either(field, header):
        return F.when(in_block, F.col(f"block.{field}")).otherwise(headers[header])

    claims = found.select(
        F.col("n").alias("source_file"),
        either("repository", "Repository").alias("repository"),
        either("organization", "Organization").alias("organization"),
        either("reference_path", "Reference").alias("reference_path"),
        F.col("block.commit_sha").alias("commit_sha"),
        F.col("symbols").alias("claimed_symbols"),
        (in_block | marked).alias("claims"),
    )
    return claims.where("claims AND repository IS NOT NULL").drop("claims")


def refused_claims(documents: DataFrame, name: str = "source_file", text: str = "text") -> DataFrame:
    """Documents with a provenance marker that cannot be read as a claim, and why."""
    return _parsed(documents, name, text).where("reject IS NOT NULL").select(F.col("n").alias("source_file"), "reject")


def _parsed(documents: DataFrame, name: str, text: str) -> DataFrame:
    marked = F.contains(F.col(text), F.lit("provenance:")) | F.contains(F.col(text), F.lit("# Provenance:"))
    slim = documents.where(marked).select(F.col(name).cast("string").alias("n"), F.col(text).alias("t"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_declared(t) for t in batch["t"]]
            out = pd.DataFrame(rows, columns=["block", "symbols", "reject"])
            yield out.assign(n=batch["n"].values, t=batch["t"].values)[["n", "block", "symbols", "reject", "t"]]

    return slim.mapInPandas(parse, f"{PARSED}, t string")


def _leaves(node, path: tuple[str, ...]):
    """The texts at a path of names and ``*`` (every entry of a list); a part of another type raises TypeError.

    A plain text where a mapping is asked for inside a list is an entry without it.
    """
    if node is None:
        return
    if not path:
        if isinstance(node, (dict, list)):
            raise TypeError("a text")
        yield str(node)
    elif path[0] == "*":
        if not isinstance(node, list):
            raise TypeError("a list")
        for entry in node:
            if path[1:] and isinstance(entry, str):
                continue
            yield from _leaves(entry, path[1:])
    elif isinstance(node, dict):
        yield from _leaves(node.get(path[0]), path[1:])
    else:
        raise TypeError("a mapping")


def _one(node, name: str) -> str | None:
    return next(_leaves(node, (name,)), None)


def _declared(text: str) -> tuple[dict | None, list[str], str | None]:
    """Provenance block, claimed symbols and, for a document of another shape, what was expected.

    Text that is no YAML may still hold headers, so it is no reject.
    """
    import yaml

    try:
        data = yaml.safe_load(text)
    except (yaml.YAMLError, ValueError, RecursionError):
        return None, [], None
    if not isinstance(data, dict):
        return None, [], None
    part = "provenance"
    try:
        block = data.get("provenance")
        if block is not None and _one(block, "repository"):
            names = ("repository", "organization", "reference_path", "commit_sha")
            return {n: _one(block, n) for n in names}, list(_leaves(block, ("verified_symbols", "*"))), None
        part = "models"
        symbols: list[str] = []
        for model in _entries(data, "models"):
            for column in _entries(model, "columns"):
                symbols += _leaves(column, ("name",))
                symbols += _leaves(column, ("tests", "*", "accepted_values", "values", "*"))
        return None, symbols, None
    except TypeError as wanted:
        return None, [], f"{part}: expected {wanted}"


def _entries(node, name: str) -> list[dict]:
    held = node.get(name) if isinstance(node, dict) else None
    if held is None and isinstance(node, dict):
        return []
    if not isinstance(held, list):
        raise TypeError("a list" if isinstance(node, dict) else "a mapping")
    return held


def _among(symbols: Column, found: Column) -> Column:
    """The symbols of a list that were found, in its order and with its repeats."""
    return F.when(F.size(F.array_distinct(symbols)) == F.size(symbols), F.array_intersect(symbols, found)).otherwise(
        F.filter(symbols, lambda s: F.array_contains(found, s))
    )


def _beyond(symbols: Column, found: Column) -> Column:
    """The symbols of a list that were not found; nulls are no symbols."""
    return F.when(F.size(F.array_distinct(symbols)) == F.size(symbols), F.array_compact(F.array_except(symbols, found))).otherwise(
        F.filter(symbols, lambda s: ~F.array_contains(found, s))
    )


def find_symbols(claims: DataFrame, files: DataFrame, on: str = "file_id", symbols: str = "symbols", text: str = "text") -> DataFrame:
    """Containment join: which claimed symbols occur in the text of the cited file.

    One row per claim.  Each file is read once, however many claims and symbols cite it;
    several files under one key count as one.
    """
    wanted = claims.select(on, F.explode(symbols).alias("symbol"))
    met = occurrences(wanted, files, scope=[on], text=text).groupBy(on).agg(F.collect_set("symbol").alias("__met"))
    known = files.where(F.col(text).isNotNull()).select(on).distinct().withColumn("__known", F.lit(True))
    joined = claims.join(known, on, "left").join(met, on, "left")
    none = F.array().cast("array<string>")
    held = _among(F.coalesce(F.col(symbols), none), F.coalesce("__met", none))
    return joined.withColumns({"file_exists": F.col("__known").isNotNull(), "found": held}).drop("__met", "__known")


def verify_claims(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Per claim: found and missing symbols, whether a cited file exists, and the verdict.

    ``files`` is a table (repository, path, content).  A claim may cite several
    paths, separated by commas; without a path all files of the repository are
    searched.  Each file is read once for the symbols claimed of its repository.
    """
    claimed = claims.select("source_file", "repository", "reference_path", F.explode("claimed_symbols").alias("symbol"))
    # (repository, path, symbol): small next to the files, and read by both kinds of claims
    met = stored(
        occurrences(claimed, files, scope=["repository"], keep=["path"], text="content").distinct(), "occurrences"
    )
    paths = F.explode(F.array_distinct(F.transform(F.split("reference_path", ","), lambda p: F.trim(p)))).alias("path")
    at_path = claimed.where("reference_path IS NOT NULL").select("source_file", "repository", "symbol", paths)
    anywhere = claimed.where("reference_path IS NULL").drop("reference_path")
    found = (
        at_path.join(met, ["repository", "path", "symbol"])
        .select("source_file", "repository", "symbol")
        .unionByName(anywhere.join(met.select("repository", "symbol").distinct(), ["repository", "symbol"]).select("source_file", "repository", "symbol"))
        # one list per claim, of its own symbols
        .groupBy("source_file", "repository")
        .agg(F.collect_set("symbol").alias("found"))
    )
    places = files.select("repository", "path").distinct()
    cited = claims.where("reference_path IS NOT NULL").select("source_file", "repository", paths).join(places, ["repository", "path"], "left_semi")
    uncited = claims.where("reference_path IS NULL").select("source_file", "repository").join(places, "repository", "left_semi")
    exists = cited.drop("path").unionByName(uncited.select("source_file", "repository")).distinct().withColumn("known", F.lit(True))
    both = claims.join(found, ["source_file", "repository"], "left").join(exists, ["source_file", "repository"], "left")
    none = F.array().cast("array<string>")
    symbols, met_symbols = F.coalesce("claimed_symbols", none), F.coalesce("found", none)
    return both.select(
        "source_file",
        "repository",
        "reference_path",
        F.col("known").isNotNull().alias("file_exists"),
        _among(symbols, met_symbols).alias("verified_symbols"),
        _beyond(symbols, met_symbols).alias("missing_symbols"),
    ).withColumn("passed", F.col("file_exists") & (F.size("missing_symbols") == 0))
