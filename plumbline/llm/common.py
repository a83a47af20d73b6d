"""What the operators of this package share: reading tables, bounded Arrow slices, fresh row ids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import scratch_path, small_batches
from plumbline.sources.tables import read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that a Python worker looks at together.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """The same rows in record batches of about ``limit`` bytes of text; one long text may be a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(lo, hi - lo)
    # A worker lives on after its task: what Arrow holds for reuse goes back to the system.
    pa.default_memory_pool().release_unused()


#: The cache that this worker has filled last.
_filled: dict = {}


def own_cache(cache: dict) -> dict:
    """``cache``, for this worker to fill; what another operator's tasks have left in theirs is let go."""
    global _filled
    if _filled is not cache:
        _filled.clear()
        _filled = cache
    return cache


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def with_row(df: DataFrame) -> DataFrame:
    """A row id next to doc_id, for tables that are stored afterwards: rows may repeat a doc_id."""
    return df.withColumn("row", F.monotonically_increasing_id())


#: For each :func:`settled` result that is being made, the tables stored for it.
_scopes: list[list[str]] = []
#: Spark's switch for dropping a query's shuffle files when it ends, rather than when the driver's memory is next cleaned.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The frame that ``make`` returns, stored; the tables that were stored on the way, and the shuffle files of finished queries, are deleted."""
    before = spark.conf.get(_CLEAN, "false")
    _scopes.append([])
    try:
        spark.conf.set(_CLEAN, "true")
        with small_batches(spark):
            df = make()
            path = scratch_path(spark, f"llm-{label}")
            df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
        for own in _scopes.pop():
            discard(spark, own)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def keep(df: DataFrame, label: str, group_rows: int | None = None) -> DataFrame:
    """Stored in the shared folder and read back: computed once, and safe from lost executors.

    With ``group_rows``, for rows of megabytes, a row group has as many: else Parquet looks at its size after 100 rows first,
    and a reader takes whole groups.
    """
    path = scratch_path(df.sparkSession, f"llm-{label}")
    if _scopes:
        _scopes[-1].append(path)
    options = {"compression": "zstd"} | ({"parquet.block.row.count.limit": group_rows} if group_rows else {})
    with small_batches(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def only(rows: DataFrame, column: str, numbers: DataFrame, label: str) -> DataFrame:
    """The rows whose number in ``column``, a long, is in the one column of ``numbers``.

    Row numbers lie close together, so 64 of them are stored and sent as one word: the table to be met is small enough to
    be broadcast where the numbers are not, and the rows, which hold the texts, stay where they are.
    """
    number, word, bits = numbers.columns[0], f"{column}_word", f"{column}_bits"
    one = F.expr(f"shiftleft(1L, cast(`{number}` & 63 as int))")
    packed = settled(rows.sparkSession, lambda: numbers.groupBy(F.shiftright(number, 6).alias(word)).agg(F.bit_or(one).alias(bits)), label)
    has = F.expr(f"shiftrightunsigned(`{bits}`, cast(`{column}` & 63 as int)) & 1 = 1")
    return rows.withColumn(word, F.shiftright(column, 6)).join(packed, word).filter(has).select(rows.columns)


def fold(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus, F.lit(-1))
