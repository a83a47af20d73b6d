"""Suffix-array dedup: removal of bytes inside strings of LENGTH bytes that start earlier elsewhere.

A string of LENGTH bytes that occurs twice has the same least GRAM-byte hash in
both places. Runs of neighbouring strings with the same least hash form one
piece of text, keyed by that hash, so equal strings always meet under one key:

1. Keys are counted; most occur once and are done. The others are marked in a
   bit filter of bounded size, which lets some unique pieces pass but loses none.
2. Marked pieces are stored. Of pieces with the same bytes only the first can hold
   anything new: the others are covered from end to end.
3. Keys with different pieces (or a piece in which the key's string occurs again)
   go to tasks in collections of bounded size. A collection is split into shards,
   each shard gets its Burrows-Wheeler transform, and the transforms are merged by
   interleave refinement (``bwt``). Blocks of suffixes with LENGTH equal symbols
   are the repeated strings; all but the first of each are covered.
   A key with more than CROWD different pieces is dealt out by the single strings'
   hashes instead, so no key's pieces need to fit one task.
4. Covered spans are merged for each document and cut out.

Order is by doc_id, then start. Documents with a null doc_id come last. Rows that
repeat doc_id and text are one document and get the same result; several texts under
one doc_id are ordered by a hash of the text. Null is the empty text. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bwt import merge, transform
from plumbline.llm.common import keep, settled, slices, utf8

LENGTH, GRAM = 100, 40
#: Strings that one piece may start; longer runs are cut.
RUN = 2048
#: Symbols of a collection, shards it is split into, pieces of one key that may share a task.
COLLECTION, SHARDS, CROWD = 1 << 17, 2, 20_000
#: Bytes of text that are hashed and cut into pieces together; they need some thirty times as much memory.
SLICE = 1 << 20
#: Bits of the filter: sixteen for each key, and this many at most (32 MB).
MOST_BITS = 1 << 28

_LAST = (1 << 63) - 1
_STEP = 1 << 16


def least_hashes(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start the least hash of the ``gram``-byte strings inside the ``length`` bytes from there; whether the first has it."""
    n, width = len(data) - length + 1, length - gram + 1
    out, leads = np.empty(max(0, n), np.uint64), np.empty(max(0, n), bool)
    for lo in range(0, n, _STEP):
        part = data[lo : lo + _STEP + length - 1].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h, base, size, done = part, 0x9E3779B97F4A7C15, 1, None
        rest, offset = gram, 0
        factor = base
        # The polynomial hash of ``gram`` bytes, from those of 1, 2, 4, ... bytes.
        while rest:
            if rest & 1:
                moved = h[offset:]
                done = moved if done is None else done[: len(moved)] * np.uint64(factor) + moved[: len(done)]
                offset += size
            rest >>= 1
            if rest:
                h = h[:-size] * np.uint64(factor) + h[size:]
                size, factor = size * 2, factor * factor % (1 << 64)
        h = done[: len(part) - gram + 1]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        m = len(h) - width + 1
        rows = np.append(h, np.full(-len(h) % width, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
        forward = np.minimum.accumulate(rows, axis=1).ravel()
        backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        out[lo : lo + m] = np.minimum(backward[:m], forward[width - 1 : width - 1 + m])
        leads[lo : lo + m] = h[:m] == out[lo : lo + m]
    return out, leads


def pieces(texts: list[bytes], length: int, gram: int):
    """(keys, starts, sizes, loops, text of each piece, offset of each text, all bytes); sizes: strings that start in a piece.

    loops: the key's string occurs again in the piece, without which no two strings of it can be equal.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none.astype(bool), none, offsets, data
    least, leads = least_hashes(data, length, gram)
    edges = np.zeros(len(least) + 2, np.int32)
    long = sizes >= length
    np.add.at(edges, offsets[long], 1)
    np.add.at(edges, offsets[long] + sizes[long] - length + 1, -1)
    valid = np.cumsum(edges[: len(least)]) > 0
    same = np.concatenate([[False], (least[1:] == least[:-1]) & valid[:-1]])
    same[offsets[long]] = False
    starts = np.flatnonzero(valid & ~same)
    stops = np.flatnonzero(valid & ~np.concatenate([same[1:] & valid[1:], [False]])) + 1
    keys, run = least[starts], stops - starts
    if len(run) and run.max() > RUN:
        parts = -(-run // RUN)
        owner = np.repeat(np.arange(len(run)), parts)
        inner = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
        starts, run, keys = starts[owner] + inner, np.minimum(RUN, run[owner] - inner), keys[owner]
    again = np.concatenate([[0], np.cumsum(leads[:-1] & same[1:] & valid[1:]), [0]])
    loops = again[starts + run - 1] > again[starts]
    return keys, starts, run, loops, np.searchsorted(offsets, starts, "right") - 1, offsets, data


def _counted(length: int, gram: int):
    def run(batches):
        for batch in slices(batches, limit=SLICE):
            keys, _, _, loops, *_ = pieces(utf8(batch), length, gram)
            keys, n = np.unique(np.concatenate([keys, keys[loops]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    return run


def _marked(shared, length: int, gram: int):
    def run(batches):
        for batch in slices(batches, limit=SLICE):
            keys, starts, sizes, loops, owner, offsets, data = pieces(utf8(batch), length, gram)
            hit = np.flatnonzero(_in_filter(keys, shared.value))
            keys, starts, sizes, loops, owner = keys[hit], starts[hit], sizes[hit], loops[hit], owner[hit]
            raw = data.tobytes()
            found = [raw[s : s + n + length - 1] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
            doc, text_id = (batch.column(c).to_numpy()[owner] for c in ("doc", "text_id"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.view(np.int64)),
                    pa.array([xxhash.xxh3_64_intdigest(p) - (1 << 63) for p in found], pa.int64()),
                    pa.array(doc, pa.int64()),
                    pa.array(text_id, pa.int64()),
                    pa.array(starts - offsets[owner], pa.int64()),
                    pa.array(loops),
                    pa.array(found, pa.binary()),
                ],
                names=["key", "form", "doc", "text_id", "start", "loops", "piece"],
            )

    return run


def _in_filter(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _passes(shared):
    """Whether a key's bit is set. Only the keys go to Python; what else a row holds stays with Spark."""

    @F.arrow_udf("boolean")
    def passes(keys: pa.Array) -> pa.Array:
        return pa.array(_in_filter(keys.to_numpy().view(np.uint64), shared.value))

    return passes


def bit_filter(keys: DataFrame) -> np.ndarray:
    """64-bit words of a filter with a bit for each key in column ``key``; at most MOST_BITS bits, whatever the number of keys."""
    n = keys.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast((key & {bits - 1}L) & 63 AS int))").alias("bit"))
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def covered(doc: np.ndarray, text_id: np.ndarray, start: np.ndarray, found: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(piece, lo, hi) spans of the pieces that hold strings which start earlier in another or the same piece."""
    step = -(-len(found) // SHARDS)
    cuts = list(range(0, len(found), step))
    parts, owners, inner = [], [], []
    for lo in cuts:
        some = found[lo : lo + step]
        parts.append(transform(some))
        sizes = np.array([len(x) + 1 for x in some])
        owners.append(lo + np.repeat(np.arange(len(some)), sizes))
        inner.append(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    merged = merge(parts, length, 2 if length % 4 else 4)
    base = np.concatenate([[0], np.cumsum([len(p.pairs) for p in parts])[:-1]])
    at = base[merged.shard] + merged.suffixes
    owner, offset = np.concatenate(owners)[at], np.concatenate(inner)[at]
    many = np.bincount(merged.block)[merged.block] > 1
    owner, offset, block = owner[many], offset[many], merged.block[many]
    if not len(owner):
        return []
    order = np.lexsort((start[owner] + offset, text_id[owner], doc[owner], block))
    owner, offset, block = owner[order], offset[order], block[order]
    later = np.concatenate([[False], block[1:] == block[:-1]])
    owner, offset = owner[later], offset[later]
    order = np.lexsort((offset, owner))
    owner, offset = owner[order], offset[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (offset[1:] > offset[:-1] + length)])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(owner) - 1]])
    return list(zip(owner[new].tolist(), offset[new].tolist(), (offset[last] + length).tolist(), strict=True))


def _collections(batches, limit: int):
    """Columns (key, doc, text_id, start, piece) of whole keys with about ``limit`` bytes; input is sorted by key."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "text_id", "start", "piece")), strict=True):
            if size >= limit and row[0] != held[-1][0]:
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield held


def _repeats(length: int):
    def run(batches):
        for rows in _collections(batches, COLLECTION):
            _, doc, text_id, start, found = zip(*rows, strict=True)
            doc, text_id, start = (np.array(x, np.int64) for x in (doc, text_id, start))
            spans = covered(doc, text_id, start, list(found), length)
            at = np.array([p for p, _, _ in spans], np.int64)
            lo, hi = (np.array([s[i] for s in spans], np.int64) for i in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[at]), pa.array(text_id[at]), pa.array(start[at] + lo), pa.array(start[at] + hi)], names=["doc", "text_id", "lo", "hi"]
            )

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc, text_id, spans (bytes, end exclusive; may overlap) to be removed from ``docs`` (doc, text_id, text).

    They are stored; the pieces, and the shuffle files of each step, are gone before the texts are cut.
    """
    return settled(docs.sparkSession, lambda: _repeated_spans(docs, length, gram, crowd), "spans")


def _repeated_spans(docs: DataFrame, length: int, gram: int, crowd: int) -> DataFrame:
    counts = docs.select("text").mapInArrow(_counted(length, gram), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    twice = keep(counts.filter("n > 1").select("key"), "keys")
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(twice))  # MOST_BITS at most
    marked = docs.mapInArrow(_marked(shared, length, gram), "key long, form long, doc long, text_id long, start long, loops boolean, piece binary")
    marked = keep(marked.withColumn("size", F.length("piece").cast("long")), "pieces")

    place = F.struct("doc", "text_id", "start")
    first = keep(marked.groupBy("key", "form").agg(F.min(place).alias("first"), F.max("loops").alias("loops"), F.count("*").alias("n")), "forms")
    copies = (
        marked.select("key", "form", "doc", "text_id", "start", "size")
        .join(first.filter("n > 1").select("key", "form", "first"), ["key", "form"])
        .filter(place != F.col("first"))
        .select("doc", "text_id", F.col("start").alias("lo"), (F.col("start") + F.col("size")).alias("hi"))
    )

    mixed = first.groupBy("key").agg(F.count("*").alias("forms"), F.max("loops").alias("loops"))
    mixed = mixed.filter((F.col("forms") > 1) | F.col("loops")).select("key", (F.col("forms") > crowd).alias("crowded"))
    mixed = keep(mixed, "mixed")
    own = docs.sparkSession.sparkContext.broadcast(bit_filter(mixed))  # MOST_BITS at most
    chosen = keep(first.filter(_passes(own)("key")).join(mixed, "key").select("key", "form", "crowded", F.col("first.*")), "chosen")
    # Only the first pieces of these keys are moved, and each once: rows that repeat a document bring equal ones.
    row = ["key", "form", "doc", "text_id", "start"]
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(chosen.select(F.xxhash64(*row).alias("key"))))  # MOST_BITS at most
    held = marked.filter(_passes(wanted)(F.xxhash64(*row))).select(*row, "size", "piece").join(chosen, row).dropDuplicates(row)
    held = keep(held.select("key", "crowded", "doc", "text_id", "start", "piece", "size"), "held")
    whole = held.filter("NOT crowded").select("key", "doc", "text_id", "start", "piece")
    single = held.filter("crowded").select("doc", "text_id", "start", "piece", F.explode(F.sequence(F.lit(0), (F.col("size") - length).cast("int"))).alias("i"))
    single = single.select("doc", "text_id", (F.col("start") + F.col("i")).alias("start"), F.substring("piece", F.col("i") + 1, F.lit(length)).alias("piece"))
    single = single.groupBy("piece").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").join(single, "piece").filter(place != F.col("first"))
    single = single.select("doc", "text_id", F.col("start").alias("lo"), (F.col("start") + length).alias("hi"))
    mixed_spans = (
        whole.repartition("key").sortWithinPartitions("key").mapInArrow(_repeats(length), "doc long, text_id long, lo long, hi long")
    )
    spans = copies.unionByName(mixed_spans).unionByName(single)
    # A document's spans are no more than its own bytes.
    return spans.distinct().groupBy("doc", "text_id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def _cut(batches):
    for batch in slices(batches):
        rows = []
        for text, spans in zip(utf8(batch), batch.column("spans").to_pylist(), strict=True):
            runs: list[list[int]] = []
            for span in spans or ():
                if runs and span["lo"] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], span["hi"])
                else:
                    runs.append([span["lo"], span["hi"]])
            ends = [0, *(x for run in runs for x in run), len(text)]
            rows.append((runs, b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(t) for t in utf8(batch)], pa.int64()),
                pa.array([[{"lo": a, "hi": b} for a, b in runs] for runs, _ in rows], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                pa.array([kept for _, kept in rows], pa.binary()),
            ],
            names=["doc_id", "n_bytes", "removed", "kept"],
        )


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, removed (spans of bytes, joined), kept (the remaining bytes) of every row of ``docs`` (doc_id, text)."""
    texts = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("text_id"))
    spans = repeated_spans(texts.select("doc", "text_id", "text"), length, gram, crowd)
    both = texts.join(spans, ["doc", "text_id"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_cut, "doc_id long, n_bytes long, removed array<struct<lo: long, hi: long>>, kept binary")
