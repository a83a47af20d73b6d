"""Byte-level BPE: encoding by merges in padded matrices, and decoding.

A pattern cuts a text into pre-tokens; each is encoded on its own. Pre-tokens
not met before become rows of matrices, one matrix for each length bucket. In
every round each row merges its leftmost pair of least rank, pairs being
looked up in a hash table of open addressing; rows that have no pair left leave
the matrix. What was encoded stays in a bounded cache of the worker.

Pre-tokens of more than LONG bytes would take quadratic time in a matrix; they
merge in the same order from a heap. Null is the empty text: no ids. Rows are
encoded one by one, other columns are ignored, an empty table gives no rows.
Decoding the ids gives the UTF-8 bytes of the text.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from plumbline.llm.common import own_cache, slices, strings

LONG, CELLS, CACHE = 1024, 1 << 20, 300_000
#: Bytes of text that are encoded together.
SLICE = 1 << 20
NONE = np.int32(np.iinfo(np.int32).max)

_tools: dict = {}


class ByteBpe:
    """Ranks of a vocabulary (bytes to id, all single bytes among them) and the pattern that cuts texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self._fill(np.array(keys, np.uint64), np.array(values, np.int32))
        self.cache: dict[str, tuple[int, ...]] = {}

    @classmethod
    def read(cls, path: str, pattern: str) -> ByteBpe:
        """From a file of lines with a token in base64 and its rank; kept for the worker's life."""
        if (path, pattern) not in _tools:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
            _tools[path, pattern] = cls(ranks, pattern)
        return _tools[path, pattern]

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << bits, NONE, np.int32)
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            at = slots[left]
            free = self.keys[at] == np.iinfo(np.uint64).max
            places, first = np.unique(at[free], return_index=True)
            placed = left[free][first]
            self.keys[places], self.values[places] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed)
            slots[left] = (slots[left] + np.uint64(1)) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where they do not merge (padding is -1)."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((held != keys) & (held != np.iinfo(np.uint64).max))
        while len(open_):
            slots[open_] = (slots[open_] + np.uint64(1)) & self.mask
            held = self.keys[slots[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (held != np.iinfo(np.uint64).max)]
        out[(left < 0) | (right < 0)] = NONE
        return out

    def merge_rows(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of pieces of like length, merged side by side in one matrix."""
        width, n = max(map(len, pieces)), len(pieces)
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((n, width), NONE, np.int32)
        ranks[:, :-1] = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        rows, out, columns = np.arange(n), [()] * n, np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            best = ranks[each, at]
            done = best == NONE
            if done.any():
                for r, row in zip(rows[done].tolist(), ids[done].tolist(), strict=True):
                    out[r] = tuple(x for x in row if x >= 0)
                stay = ~done
                rows, ids, ranks, at, best = rows[stay], ids[stay], ranks[stay], at[stay], best[stay]
                if not len(rows):
                    break
                each = np.arange(len(rows))
            # Everything right of the merged pair moves one place to the left; the last column is padding from now on.
            move = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids[each, at] = best
            ids, ranks = np.take_along_axis(ids, move, 1), np.take_along_axis(ranks, move, 1)
            ids[:, -1], ranks[:, -1] = -1, NONE
            after = np.minimum(at + 1, width - 1)
            ranks[each, at] = np.where(at + 1 < width, self.pairs(ids[each, at], ids[each, after]), NONE)
            inner = at > 0
            if inner.any():
                e, a = each[inner], at[inner]
                ranks[e, a - 1] = self.pairs(ids[e, a - 1], ids[e, a])
            used = int((ids >= 0).any(axis=0).sum())
            if used < width * 3 // 4:
                width = max(2, used)
                ids, ranks, columns = ids[:, :width], ranks[:, :width], columns[:width]
        return out

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges for one long piece, the leftmost pair of least rank from a heap."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.pairs(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i, i + 1, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)

        def rank(i, j):
            merged = self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[j]])
            if merged is not None:
                heapq.heappush(heap, (merged, i, j, ids[i], ids[j]))

        while heap:
            merged, i, j, a, b = heapq.heappop(heap)
            if ids[i] != a or after[i] != j or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merged, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                rank(i, after[j])
            if before[i] >= 0:
                rank(before[i], i)
        return tuple(x for x in ids if x >= 0)

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = (whole,)
            elif len(piece) > LONG:
                out[i] = self.merge_long(piece)
            else:
                buckets.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, members in sorted(buckets.items()):
            step = max(1, CELLS // width)
            for lo in range(0, len(members), step):
                part = members[lo : lo + step]
                for i, ids in zip(part, self.merge_rows([pieces[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        cut = [self.pattern.findall(t) for t in texts]
        words = set(chain.from_iterable(cut))
        fresh = [w for w in words if w not in self.cache]
        if len(self.cache) + len(fresh) > CACHE:
            self.cache.clear()
            fresh = list(words)
        known = self.cache
        known.update(zip(fresh, self.encode_pieces([w.encode() for w in fresh]), strict=True))
        out = [list(chain.from_iterable([known[w] for w in parts])) for parts in cut]
        if len(known) > CACHE:
            known.clear()
        return out

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded (bytes) of every row of ``docs`` (doc_id, text) under a rank file, which every worker has."""

    def run(batches):
        bpe = ByteBpe.read(path, pattern)
        own_cache(bpe.cache)
        for batch in slices(batches, limit=SLICE):
            ids = bpe.encode_batch(strings(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.binary())],
                names=["doc_id", "ids", "decoded"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
