"""A training-data pipeline over ``documents``.

Quality filter, exact dedup, near-dedup, benchmark decontamination, then
encoding. Each stage works on what the one before has kept and returns the
columns of its input, but for the last, which returns the digests of the ids.

Every row is judged by itself: rows are numbered, and the operators decide on the
numbers, so different texts under one doc_id stay apart. Of equal or near texts the
row with the smallest doc_id stays, or the first one if none has a doc_id. A stage stores
the numbers it keeps, and its rows if they are not those of files; what its operator stored on the way is deleted. Null texts are empty
ones; of all empty texts one passes exact dedup. Without labels of both kinds
the quality stage keeps everything. Empty tables give no rows, columns beyond
those of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, exact_dedup, near_dedup, quality
from plumbline.llm.common import keep, only, read, settled
from plumbline.llm.queries import bpe_digests

#: Texts below this probability of being good are rejected.
LEAST_QUALITY = 0.5
#: Shingle sets with this percentage in common are near copies.
NEAR_PERCENT = 80
#: More rows than a file holds.
ROWS = 1 << 40


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"))
    if model.dictionaries is None:
        return docs
    name = _free(docs, "score")
    return quality.score_text(docs, model, name).filter(F.col(name) >= LEAST_QUALITY).drop(name)


def _reread(docs: DataFrame) -> bool:
    """Whether ``docs`` is a table of files just as it was read, so that a row is known by its file and place."""
    plan = docs._jdf.queryExecution().analyzed()
    return plan.nodeName() == "LogicalRelation" and bool(docs.inputFiles()) and "_metadata" not in docs.columns


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """The rows with a number each, the same as the operators take them (doc_id: the number), and the number's column.

    Rows of files are numbered by file and place, which every read finds again; others are stored first.
    """
    number = _free(docs, "number")
    if _reread(docs):
        file, place = _free(docs, "file"), _free(docs, "place")
        paths = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())  # one row a file
        files = docs.sparkSession.createDataFrame(list(zip(paths, range(len(paths)), strict=True)), f"{file} string, {number} long")
        placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
        # Spark takes a list from the driver for a table of unknown size: without the hint it would move the texts to meet the names.
        rows = placed.join(F.broadcast(files), file).withColumn(number, F.col(number) * ROWS + F.col(place)).select(*docs.columns, number)
    else:
        rows = keep(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    return rows, rows.select(F.col(number).alias("doc_id"), "text"), number


def _first_of_each(rows: DataFrame, groups: DataFrame, number: str) -> DataFrame:
    """doc_id (a number) of the row with the smallest doc_id of each group; groups: doc_id (a number), group."""
    named = rows.select(F.col(number).alias("own"), F.col("doc_id").alias("name"))
    first = F.min(F.struct(F.isnull("name").alias("last"), "name", "own")).alias("first")
    return groups.join(named, F.col("doc_id") == F.col("own")).groupBy("group").agg(first).select(F.col("first.own").alias("doc_id"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, texts, number = _numbered(docs)

    def decide():
        groups = exact_dedup.exact_dedup(texts).select("doc_id", F.col("keep_id").alias("group"))
        return _first_of_each(rows, groups, number)

    return only(rows, number, settled(spark, decide, "exact-numbers"), "exact-words").select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id of each group of near copies, and texts without words."""
    rows, texts, number = _numbered(docs)

    def decide():
        groups = near_dedup.near_dedup(texts, NEAR_PERCENT, numbered=True).select("doc_id", F.col("component_id").alias("group"))
        return _first_of_each(rows, groups, number)

    return only(rows, number, settled(spark, decide, "near-numbers"), "near-words").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, texts, number = _numbered(docs)

    def decide():
        return decontaminate.contamination(texts, read(spark, sf_dir, "benchmark")).filter(F.size("spans") == 0).select("doc_id")

    return only(rows, number, settled(spark, decide, "clean-numbers"), "clean-words").select(docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: SQL does not express the classifier; the tests hold the run against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    def stages():
        docs = read(spark, sf_dir, "documents")
        for name, stage in STAGES:
            docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        return docs

    return settled(spark, stages, "pipeline")
