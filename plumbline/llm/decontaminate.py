"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores, for every few megabytes of text (a shard), each word
with the sorted list of its positions. The words of neighbouring documents are
one position apart from touching, so no phrase crosses documents. The index
knows nothing of a benchmark and serves any number of searches.

A search takes the test items in blocks of a bounded number of words, which are
sent to every worker; each block is run against all shards, and its hits are stored
before the next. Shards are stored, read and handed to a worker a few at a time, whatever
the size of the files. In a shard the
terms of a window are ordered by the length of their lists. The list of the
rarest gives the possible starts, and these are intersected with the other
lists, each moved by its term's offset, from rare to frequent (``phrase_hits``).
``near_hits`` asks for all terms of an item within a distance instead.

Words are runs of letters and digits of lower-cased text (A-Z only; anything
beyond ASCII counts as a letter). Null and empty texts have no words. Items
without words are left out; items with one id count once. Items without id are
searched like any other: a document that holds one has a single null in its
list of items, after the ids. Repeated rows are judged one by one, other columns
are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import keep, slices, utf8

WINDOW = 10
#: Words of test items that are searched together, windows that a shard handles at a time, and the entries of their rarest terms' lists.
BLOCK_WORDS, STEP, ENTRIES = 500_000, 4096, 1 << 18
#: Shards, of a few megabytes each, that are stored as one row group, which is what a writer and a reader hold.
GROUP_SHARDS = 2

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

INDEX_SCHEMA = "doc_ids array<long>, n_words array<long>, terms array<binary>, counts binary, positions binary"
HIT_SCHEMA = "shard long, place int, items array<string>, spans array<struct<lo: long, hi: long>>"


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def _index(batches):
    for batch in slices(batches):
        known: dict[bytes, int] = {}
        ids, sizes = [], []
        for text in utf8(batch):
            own = words(text)
            sizes.append(len(own))
            ids.append(np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own)))
        starts = _starts(np.array(sizes, np.int64))
        places = [np.arange(s, s + n) for s, n in zip(starts.tolist(), sizes, strict=True)]
        keys = np.sort(np.concatenate(ids) << 32 | np.concatenate(places))
        counts = np.bincount(keys >> 32, minlength=len(known)).astype(np.int32)
        positions = (keys & 0xFFFFFFFF).astype(np.int32)
        columns = [batch.column("doc_id").to_pylist(), sizes, list(known), counts.tobytes(), positions.tobytes()]
        types = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c], t) for c, t in zip(columns, types, strict=True)], names=["doc_ids", "n_words", "terms", "counts", "positions"]
        )


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Position of each document's first word; one position stays free between documents."""
    return np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of all words of ``docs`` (doc_id, text), a row for each shard."""
    rows = docs.select("doc_id", "text").mapInArrow(_index, INDEX_SCHEMA)
    return keep(rows.withColumn("shard", F.monotonically_increasing_id()), "index", GROUP_SHARDS)


class Shard:
    """The lists of one shard for the terms of a search."""

    def __init__(self, row: dict, terms: list[bytes]):
        self.sizes = np.array(row["n_words"], np.int64)
        self.starts = _starts(self.sizes)
        counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        positions = np.frombuffer(row["positions"], np.int32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        place = {t: i for i, t in enumerate(row["terms"])}
        self.local = np.array([place.get(t, -1) for t in terms], np.int64)
        self.df = np.where(self.local >= 0, np.append(counts, 0)[self.local], 0)
        self.positions = positions
        self.keys = np.repeat(np.arange(len(counts)), counts) << 32 | positions

    def holds(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each position is in the list of its term."""
        wanted = self.local[terms] << 32 | positions
        at = np.searchsorted(self.keys, wanted)
        return (positions >= 0) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(owner, position) of every entry of the terms' lists, one after the other."""
        df = self.df[terms]
        owner = np.repeat(np.arange(len(terms)), df)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(df) - df, df)
        return owner, self.positions[self.first[self.local[terms]][owner] + inner]

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every occurrence; windows: a row of terms each, all of one length."""
        found = []
        for lo in range(0, len(windows), STEP):
            some = lo + np.flatnonzero((self.df[windows[lo : lo + STEP]] > 0).all(axis=1))
            part = np.cumsum(self.df[windows[some]].min(axis=1)) // ENTRIES
            for own in np.split(some, np.flatnonzero(np.diff(part)) + 1) if len(some) else ():
                order = np.argsort(self.df[windows[own]], axis=1, kind="stable")
                owner, at = self.lists(windows[own, order[:, 0]])
                start = at - order[owner, 0]
                for k in range(1, windows.shape[1]):
                    offset = order[owner, k]
                    hit = self.holds(windows[own[owner], offset], start + offset)
                    owner, start = owner[hit], start[hit]
                found.append((own[owner], start))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([w for w, _ in found]), np.concatenate([s for _, s in found])

    def near(self, terms: np.ndarray, distance: int) -> np.ndarray:
        """Positions of the rarest of ``terms`` that have all others within ``distance`` words in their document."""
        if not (self.df[terms] > 0).all():
            return np.zeros(0, np.int64)
        order = terms[np.argsort(self.df[terms], kind="stable")]
        _, at = self.lists(order[:1])
        for term in order[1:]:
            own = self.positions[self.first[self.local[term]] : self.first[self.local[term] + 1]]
            doc = self.document(at)
            lo = np.maximum(at - distance, self.starts[doc])
            hi = np.minimum(at + distance, self.starts[doc] + self.sizes[doc] - 1)
            at = at[np.searchsorted(own, lo) < np.searchsorted(own, hi, "right")]
        return at


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """(id as text or None, words) of the items, in lists of about ``block_words`` words."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        own = words((row["text"] or "").encode())
        if not own:
            continue
        block.append((row["item_id"], own))
        size += len(own)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def windows_of(block: list[tuple[str | None, list[bytes]]], window: int) -> tuple[list[str | None], list[bytes], dict[int, np.ndarray]]:
    """Item ids, distinct terms, and for each window length an array of rows (item, term, term, ...)."""
    ids, known, rows = [], {}, {}
    for place, (item, own) in enumerate(block):
        ids.append(item)
        terms = [known.setdefault(w, len(known)) for w in own]
        size = min(window, len(terms))
        rows.setdefault(size, set()).update((place, *terms[i : i + size]) for i in range(len(terms) - size + 1))
    return ids, list(known), {size: np.array(sorted(r), np.int64) for size, r in rows.items()}


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans joined where they overlap or touch."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], np.concatenate([end[:-1][new[1:]], end[-1:]])


def _search(shared):
    def run(batches):
        ids, terms, groups = shared.value
        names = np.array(ids, object)
        for batch in batches:
            for row in batch.to_pylist():
                shard, out = Shard(row, terms), []
                if len(shard.positions):
                    got = [(g[w, 0], s, s + size) for size, g in groups.items() for w, s in [shard.phrases(g[:, 1:])]]
                    item, start, end = (np.concatenate(x) for x in zip(*got, strict=True))
                    if len(item):
                        doc = shard.document(start)
                        pairs = np.unique(np.stack([doc, item]), axis=1)
                        lo, hi = _merged(start, end)
                        at = shard.document(lo)
                        for d in np.unique(doc).tolist():
                            spans = [{"lo": x, "hi": y} for x, y in zip((lo[at == d] - shard.starts[d]).tolist(), (hi[at == d] - shard.starts[d]).tolist(), strict=True)]
                            out.append({"shard": row["shard"], "place": d, "items": list(set(names[pairs[1][pairs[0] == d]])), "spans": spans})
                yield pa.RecordBatch.from_pylist(out, schema=_HITS)

    return run


_HITS = pa.schema(
    [("shard", pa.int64()), ("place", pa.int32()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))]
)


def _found(spark: SparkSession, index: DataFrame, search, blocks, schema: str) -> DataFrame:
    """What ``search`` of each block finds in the shards. A block's hits are stored, and what was sent for it is let go, before the next is sent."""
    out = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(block)  # block_words words at most, beside one long item
        own = keep(index.mapInArrow(search(shared), schema), "hits")
        shared.destroy()
        out = own if out is None else out.union(own)
    return out if out is not None else spark.createDataFrame([], schema)


def phrase_hits(spark: SparkSession, index: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """shard, place, items, spans (words, end exclusive) of the documents in which windows of ``items`` (item_id, text) occur.

    A window is ``window`` words in a row; an item of fewer is one window.
    """
    return _found(spark, index, _search, (windows_of(block, window) for block in item_blocks(items, block_words)), HIT_SCHEMA)


def near_hits(spark: SparkSession, index: DataFrame, items: DataFrame, distance: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """shard, place, item_id, word: where an item's rarest term has all its other terms within ``distance`` words."""

    def search(shared):
        def run(batches):
            ids, terms, sets = shared.value
            for batch in batches:
                for row in batch.to_pylist():
                    shard, out = Shard(row, terms), []
                    for item, own in zip(ids, sets, strict=True):
                        at = shard.near(own, distance)
                        docs = shard.document(at)
                        out += [(row["shard"], d, item, w) for d, w in zip(docs.tolist(), (at - shard.starts[docs]).tolist(), strict=True)]
                    columns = list(zip(*out, strict=True)) or [()] * 4
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int64()), strict=True)],
                        names=["shard", "place", "item_id", "word"],
                    )

        return run

    def terms_of(block):
        known: dict[bytes, int] = {}
        sets = [np.unique([known.setdefault(w, len(known)) for w in own]) for _, own in block]
        return [i for i, _ in block], list(known), sets

    return _found(spark, index, search, map(terms_of, item_blocks(items, block_words)), "shard long, place int, item_id string, word long")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, items (sorted ids, then null for items without id), spans of hit words for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    index = build_index(docs)
    hits = phrase_hits(spark, index, items, window, block_words)
    hits = hits.groupBy("shard", "place").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")
    )
    rows = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("place", "d"))
    return rows.join(hits, ["shard", "place"], "left").select(
        F.col("d.doc_ids").alias("doc_id"),
        F.col("d.n_words").alias("n_words"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<lo: bigint, hi: bigint>>")).alias("spans"),
    )


def hit_words(spans):
    """Number of words inside sorted spans that may overlap."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), x["hi"] - F.greatest(x["lo"], s["end"]))).alias("n"), F.greatest(s["end"], x["hi"]).alias("end")
        ),
        lambda s: s["n"],
    )


SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS phrase
    FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
    SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
    FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n
), hits AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, phrase)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
