"""Exact dedup by content-defined chunk recipes.

Texts count as equal once every run of blanks is one space. Each text is cut
where a rolling hash of its last bytes says so, so a chunk is found again
wherever it stands. Chunks travel once: their bytes are grouped under a 64-bit
key, which verifies that a key stands for one byte string. Documents are then
compared by their ordered lists of chunk keys alone; no text is moved for that.
Where a key stands for several byte strings, the texts whose recipes hold it,
and no others, go through an exact second pass (``_told_apart``).

Null and empty texts are equal to each other. Of repeated rows with one doc_id
exactly one stays. A null doc_id comes after all others when the row that stays
is chosen. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import keep, slices, utf8, with_row

#: Chunk sizes in bytes: no cut before the least, one at the most, about MEAN between cuts otherwise.
LEAST, MEAN, MOST = 1024, 4096, 65536

_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_RUN = re.compile(rb" {2,}")
#: One pseudo-random word for each byte value.
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def normalised(text: bytes) -> bytes:
    flat = text.translate(_BLANKS)
    return _RUN.sub(b" ", flat) if b"  " in flat else flat


def chunks(text: bytes) -> list[bytes]:
    """The text cut where the hash of the 16 bytes before says so."""
    if len(text) <= LEAST:
        return [text]
    h = _GEAR[np.frombuffer(text, np.uint8)]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    marks = np.flatnonzero((h >> np.uint32(8)) % np.uint32(MEAN - LEAST) == 0) + 1
    out, start = [], 0
    for cut in [*marks.tolist(), len(text)]:
        while cut - start > MOST:
            out.append(text[start : start + MOST])
            start += MOST
        if cut - start >= LEAST or cut == len(text) and cut > start:
            out.append(text[start:cut])
            start = cut
    return out


def chunk_key(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - (1 << 63)


def _recipes(key: Callable[[bytes], int]):
    def run(batches):
        for batch in slices(batches):
            texts = [normalised(t) for t in utf8(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    pa.array([[key(c) for c in chunks(t)] for t in texts], pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_sha256", "keys"],
            )

    return run


def _pieces(key: Callable[[bytes], int]):
    def run(batches):
        for batch in slices(batches):
            found = {c for t in utf8(batch) for c in chunks(normalised(t))}
            yield pa.RecordBatch.from_arrays(
                [pa.array([key(c) for c in found], pa.int64()), pa.array(list(found), pa.binary())], names=["key", "piece"]
            )

    return run


def _holding(recipes: DataFrame, clashes: DataFrame) -> DataFrame:
    """text_sha256 of the texts whose recipes hold a clashing key."""
    held = recipes.select("text_sha256", F.explode("keys").alias("key")).join(clashes, "key", "left_semi")
    return held.select("text_sha256").distinct()


def _told_apart(moved: DataFrame, clashes: DataFrame, key: Callable[[bytes], int]) -> DataFrame:
    """Recipes of ``moved`` (row, doc_id, text, text_sha256) in which each key is followed by the number of its byte string."""
    forms = (
        moved.mapInArrow(_pieces(key), "key long, piece binary")
        .join(clashes, "key", "left_semi")
        .distinct()
        .groupBy("key")
        .agg(F.array_sort(F.collect_set("piece")).alias("forms"))
    )

    def own(batches):
        for batch in slices(batches):
            rows = [(r, i, key(c), c) for r, t in zip(batch.column("row").to_pylist(), utf8(batch), strict=True) for i, c in enumerate(chunks(normalised(t)))]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())],
                names=["row", "place", "key", "piece"],
            )

    named = (
        moved.mapInArrow(own, "row long, place long, key long, piece binary")
        .join(forms, "key", "left")
        .select("row", "place", "key", F.coalesce(F.array_position("forms", F.col("piece")), F.lit(0)).alias("form"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("place", "key", "form"))).alias("named"))
        .select("row", F.flatten(F.transform("named", lambda x: F.array(x["key"], x["form"]))).alias("keys"))
    )
    return moved.drop("text").join(named, "row")


def exact_dedup(docs: DataFrame, key: Callable[[bytes], int] = chunk_key) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text)."""
    texts = docs.select("doc_id", "text")
    clashes = (
        texts.mapInArrow(_pieces(key), "key long, piece binary").distinct().groupBy("key").count().filter("count > 1").select("key")
    )
    clashes = keep(clashes, "clashes")
    recipes = keep(with_row(texts.mapInArrow(_recipes(key), "doc_id long, text_sha256 string, keys array<long>")), "recipes")
    if not clashes.isEmpty():
        holding = keep(_holding(recipes, clashes), "holding")
        sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
        moved = keep(with_row(texts.withColumn("text_sha256", sha).join(holding, "text_sha256", "left_semi")), "moved")
        apart = _told_apart(moved, clashes, key)
        # the lists of both parts differ: a clashing key stands first in a pair of the one, and nowhere in the other
        recipes = keep(recipes.join(holding, "text_sha256", "left_anti").unionByName(apart), "apart")
    groups = recipes.groupBy("keys").agg(
        F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "row")).alias("first"), F.count("*").alias("group_size")
    )
    return recipes.join(groups, "keys").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )


SQL = r"""
WITH t AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
    SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
