"""Cross-tokenizer alignment by galloping intersection of token ends.

Two tokenizers A and B cut the same bytes. Byte offsets at which a token of either
ends are the only places to cut the text for both: they split the tokens into
groups, and tokens of one group are linked. To find them the shorter list of ends
drives: for each of its ends the search in the longer list starts where the end
should be if both ran evenly, doubles its step until the end is passed, and halves
the bracket. Indices of common ends slice the groups, their differences are the
numbers of tokens that overlap.

Texts are cut into chunks that no token crosses, and a worker keeps the ids of
chunks it has met, so the libraries encode a chunk once; a text with unusual blanks goes through A's library as a whole.
Texts that both tokenizers cut at the same places are cut and looked up once for both. New words go through A's library in rows of ROW.

An id pair's count, the number of rows that hold it linked, covers all rows. Each row
stores its distinct pairs, Spark counts them, and the counts come back in two tiers:
those of frequent pairs (at most TABLE) are broadcast, the rest is joined by pair, where no pair is frequent.
The bound changes nothing but speed. A group with many tokens on both sides is reduced to distinct ids before
its pairs are formed.

Null and empty texts, and texts whose token bytes are not a blank and the text, have
no tokens: zeros and an empty digest. Rows are aligned one by one and counted each, repeated rows too; a null doc_id stays
null. Other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import token_counts
from plumbline.llm.common import keep, slices, with_row

#: Broadcast pair counts; chunks and bytes of them a worker keeps; bytes of text aligned together; pairs a group may have before it is reduced.
TABLE, CACHE, CACHE_BYTES, SLICE, REDUCE = 1_000_000, 450_000, 64 << 20, 1 << 20, 4096

#: Blanks as A's pre-tokenizer cuts at them; only for texts without other characters that some library takes for blanks.
_CHUNK = re.compile("[ ]?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
#: A blank and a word without characters that some library takes for blanks: A cuts a row of them as it cuts each.
_WORD = re.compile("[ ][^\t-\r \x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]+")
_BLANK = "▁".encode()
#: Chunks of A that are chunks of B, whatever stands next to them, in texts that hold no others.
_SHARED = re.compile("[ ]?[^\t-\r \x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff▁]+|[\n\t]")
#: Words that A's library gets in a row.
ROW = 100

_tools: dict = {}


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids one list after the other, ids of each list)."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, sizes.sum()), sizes


class ByteLevelTokenizer:
    """A: a byte-level tokenizer of the tokenizers library; encodes a blank and the text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        self.tool.encode_special_tokens = True
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        own = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.tokens = [b""] * self.tool.get_vocab_size()
        for token, i in self.tool.get_vocab().items():
            self.tokens[i] = bytes(own[c] for c in token)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def chunks(self, text: str) -> list[str]:
        return [" " + text] if _ODD.search(text) else _CHUNK.findall(" " + text)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat([e.ids for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)])

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        is_word = np.array([_WORD.fullmatch(c) is not None for c in chunks], bool)
        words = [chunks[i] for i in np.flatnonzero(is_word)]
        ids, _ = self._ids(["".join(words[lo : lo + ROW]) for lo in range(0, len(words), ROW)])
        stops, ends = np.cumsum([len(w.encode()) for w in words], dtype=np.int64), np.cumsum(self.lengths[ids])
        last = np.searchsorted(ends, stops)
        if len(ids) and (self.lengths[ids].min() < 1 or ends[-1] != stops[-1] or not np.array_equal(ends[last], stops)) or not len(ids) and words:
            return self._ids(chunks)  # tokens of other bytes than the words': their ends say nothing
        rest, n = self._ids([chunks[i] for i in np.flatnonzero(~is_word)])
        sizes = np.empty(len(chunks), np.int64)
        sizes[is_word], sizes[~is_word] = np.diff(last, prepend=-1), n
        out, of_word = np.empty(len(ids) + len(rest), np.int32), np.repeat(is_word, sizes)
        out[of_word], out[~of_word] = ids, rest
        return out, sizes


class PieceTokenizer:
    """B: a sentencepiece model, which puts the blank there itself."""

    def __init__(self, path: str):
        self.tool, _ = token_counts.load(path)
        pieces = [self.tool.id_to_piece(i) for i in range(self.tool.get_piece_size())]
        self.tokens = [bytes([int(p[3:-1], 16)]) if self.tool.is_byte(i) else p.encode().replace(_BLANK, b" ") for i, p in enumerate(pieces)]

    def chunks(self, text: str) -> list[bytes]:
        return token_counts.pre_tokens(text.encode())

    def encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.tool.encode([c.decode() for c in chunks], num_threads=1))


class Ids:
    """Ids of chunks, by the chunk's number, and whether the tokens' bytes are the chunk's."""

    def __init__(self, tokenizer):
        self.tokenizer, self.tokens = tokenizer, tokenizer.tokens
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.clear()

    def clear(self):
        self.ids, self.starts, self.sizes, self.whole = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def learn(self, chunks: list, raw: list[bytes], known: np.ndarray | None = None):
        """Appends the chunks; those not in ``known`` have no ids and are not whole."""
        if known is not None and not known.all():
            at = np.flatnonzero(known).tolist()
            ids, some, good = self._encoded([chunks[i] for i in at], [raw[i] for i in at])
            sizes, whole = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), bool)
            sizes[at], whole[at] = some, good
        else:
            ids, sizes, whole = self._encoded(chunks, raw)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes, self.whole = np.concatenate([self.sizes, sizes]), np.concatenate([self.whole, whole])
        self.ids = np.concatenate([self.ids, ids])

    def _encoded(self, chunks: list, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, sizes = self.tokenizer.encode(chunks)
        ends, n_bytes = np.cumsum(sizes), np.fromiter(map(len, raw), np.int64, len(raw))
        upto = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        whole = upto[ends] - upto[ends - sizes] == n_bytes
        tokens = [self.tokens[i] for i in ids.tolist()]
        # All at once, and one by one only if some differ.
        if not whole.all() or b"".join(tokens) != b"".join(raw):
            whole = np.array([b"".join(tokens[e - n : e]) == c for c, e, n in zip(raw, ends.tolist(), sizes.tolist(), strict=True)], bool)
        return ids, sizes, whole

    def of(self, at: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids one text after the other, ids of each text, whether its chunks are whole); at: the texts' chunks, owner: the text of each."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.bincount(owner, sizes, texts).astype(np.int64), np.bincount(owner, ~self.whole[at], texts) == 0


class Encoder(Ids):
    """Ids of texts by chunks, which are kept within bounds; with ``other``, the ids of chunks that both tokenizers cut, by the same numbers."""

    def __init__(self, tokenizer, other=None):
        self.other = Ids(other) if other else None
        super().__init__(tokenizer)

    def clear(self):
        super().clear()
        self.known: dict = {}
        self.bytes, self.shared = 0, np.zeros(0, bool)
        if self.other:
            self.other.clear()

    def _learn(self, chunks: list):
        raw = [c.encode() if isinstance(c, str) else c for c in chunks]
        self.learn(chunks, raw)
        if self.other:
            shared = np.array([_SHARED.fullmatch(c) is not None for c in chunks], bool)
            self.other.learn(raw, raw, shared)
            self.shared = np.concatenate([self.shared, shared])
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks)), strict=True))
        self.bytes += sum(map(len, chunks))

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the texts' chunks, one text after the other, the text of each)."""
        parts = [self.tokenizer.chunks(t) for t in texts]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        if len(self.known) > CACHE or self.bytes > CACHE_BYTES:
            self.clear()
        flat = list(chain.from_iterable(parts))
        at = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missed = np.flatnonzero(at < 0).tolist()
        if missed:
            self._learn(list({flat[i] for i in missed}))
            at[missed] = [self.known[flat[i]] for i in missed]
        return at, np.repeat(np.arange(len(parts)), n)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids one text after the other, ids of each text, whether its chunks' bytes are those of their tokens)."""
        return self.of(*self.places(texts), len(texts))


def gallop(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Index in the ascending ``long`` of every value of ``short``, -1 where it is missing; ``start`` is where to look first.

    All values search at once; those that have their bracket wait for the others.
    """
    n = len(long)
    at = np.clip(start, 0, n - 1)
    right = long[at] < short
    # The first index that is not below the value lies in (low, high].
    low, high = np.where(right, at, -1), np.where(right, n, at)
    for way, left in ((1, np.flatnonzero(right)), (-1, np.flatnonzero(~right))):
        step = 1
        while len(left):
            probe = at[left] + way * step
            inside = (probe < n) & (probe >= 0)
            left, probe = left[inside], probe[inside]
            below = long[probe] < short[left]
            low[left[below]], high[left[~below]] = probe[below], probe[~below]
            left = left[below if way > 0 else ~below]
            step *= 2
    left = np.flatnonzero(high - low > 1)
    while len(left):
        middle = (low[left] + high[left]) // 2
        below = long[middle] < short[left]
        low[left[below]], high[left[~below]] = middle[below], middle[~below]
        left = left[high[left] - low[left] > 1]
    return np.where((high < n) & (long[np.minimum(high, n - 1)] == short), high, -1)


@dataclass(frozen=True)
class Alignment:
    """Tokens of several texts, one text after the other, and the groups that common ends cut them into."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray  #: tokens of A of each text
    n_b: np.ndarray
    cut_a: np.ndarray  #: for each group, the tokens of A up to its end
    cut_b: np.ndarray
    n_groups: np.ndarray  #: groups of each text

    @property
    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.diff(self.cut_a, prepend=0), np.diff(self.cut_b, prepend=0)


def _first(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def common_ends(ends_a: np.ndarray, n_a: np.ndarray, ends_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the ends that both lists have; lists of several texts follow each other, ascending over all."""
    found = []
    for drives in (n_a <= n_b, n_a > n_b):
        (short, n_s), (long, n_l) = ((ends_a, n_a), (ends_b, n_b)) if not found else ((ends_b, n_b), (ends_a, n_a))
        own, other = np.flatnonzero(np.repeat(drives, n_s)), np.flatnonzero(np.repeat(drives, n_l))
        size, more = n_s[drives], n_l[drives]
        place = np.arange(len(own)) - np.repeat(_first(size), size)
        start = np.repeat(_first(more), size) + place * np.repeat(more, size) // np.repeat(size, size)
        index = gallop(short[own], long[other], start) if len(own) else np.zeros(0, np.int64)
        hit = index >= 0
        pair = own[hit], other[index[hit]] if hit.any() else np.zeros(0, np.int64)
        found.append(pair if not found else pair[::-1])
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        pieces = PieceTokenizer(path_b)
        self.one, self.two = Encoder(ByteLevelTokenizer(path_a), pieces), Encoder(pieces)
        digits = [[str(i).encode() for i in range(len(e.tokens))] for e in (self.one, self.two)]
        self.texts = [{sep: np.array([d + sep for d in own], object) for sep in seps} for own, seps in zip(digits, ((b",", b"|"), (b",", b";", b"")), strict=True)]

    @classmethod
    def read(cls, path_a: str, path_b: str) -> Aligner:
        """Of two files that every worker has; kept for the worker's life."""
        if (path_a, path_b) not in _tools:
            _tools[path_a, path_b] = cls(path_a, path_b)
        return _tools[path_a, path_b]

    @property
    def width(self) -> int:
        """Ids of B; a pair (a, b) is the number a * width + b."""
        return len(self.two.tokens)

    def _encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What ``encode`` of A and of B gives; a text that both cut alike is cut and looked up once."""
        at, owner = self.one.places(texts)
        a = self.one.of(at, owner, len(texts))
        alike = np.bincount(owner, ~self.one.shared[at], len(texts)) == 0
        own = alike[owner]
        ids, n, whole = self.one.other.of(at[own], owner[own], len(texts))
        if not alike.all():
            other = self.two.encode([texts[i] for i in np.flatnonzero(~alike)])
            n[~alike], whole[~alike] = other[1:]
            mixed, of_both = np.empty(n.sum(), np.int32), np.repeat(alike, n)
            mixed[of_both], mixed[~of_both] = ids, other[0]
            ids = mixed
        return [a, (ids, n, whole)]

    def align(self, texts: list[str | None]) -> Alignment:
        texts = [t or "" for t in texts]
        encoded = []
        good = np.array([t != "" for t in texts], bool)
        for e, (ids, n, whole) in zip((self.one, self.two), self._encode(texts), strict=True):
            first = _first(n)
            for i in np.flatnonzero(~whole | np.array([_BLANK in t.encode() for t in texts], bool) if e is self.two else ~whole):
                whole[i] = b"".join(e.tokens[t] for t in ids[first[i] : first[i] + n[i]]) == b" " + texts[i].encode()
            encoded.append((ids, n))
            good &= whole
        (a, n_a), (b, n_b) = ((ids[np.repeat(good, n)], np.where(good, n, 0)) for ids, n in encoded)
        # Texts follow each other with their bytes, so ends ascend and a text's last end is common.
        i, j = common_ends(np.cumsum(self.one.lengths[a]), n_a, np.cumsum(self.two.lengths[b]), n_b)
        last = np.cumsum(n_a)
        n_groups = np.diff(np.searchsorted(i, last, "left"), prepend=0)
        return Alignment(a, b, n_a, n_b, i + 1, j + 1, n_groups)

    def digests(self, found: Alignment) -> list[str]:
        """sha256 of each text's groups as ``a1,a2|b1;a3|b2,b3``, '' without tokens."""
        size_a, size_b = found.sizes
        ends_a, ends_b = np.zeros(len(found.a), bool), np.zeros(len(found.b), bool)
        ends_a[found.cut_a - 1], ends_b[found.cut_b - 1] = True, True
        out = np.empty(len(found.a) + len(found.b), object)
        text_a, text_b = self.texts[0][b","][found.a], self.texts[1][b","][found.b]
        text_a[ends_a], text_b[ends_b] = self.texts[0][b"|"][found.a[ends_a]], self.texts[1][b";"][found.b[ends_b]]
        last = np.cumsum(found.n_b)[found.n_b > 0] - 1
        text_b[last] = self.texts[1][b""][found.b[last]]
        out[np.arange(len(found.a)) + np.repeat(found.cut_b - size_b, size_a)] = text_a
        out[np.arange(len(found.b)) + np.repeat(found.cut_a, size_b)] = text_b
        cuts = [0, *np.cumsum(found.n_a + found.n_b).tolist()]
        return [hashlib.sha256(b"".join(out[lo:hi].tolist())).hexdigest() if lo < hi else "" for lo, hi in zip(cuts, cuts[1:], strict=False)]

    def pairs(self, found: Alignment) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct linked pairs, links of each, pairs of each text, links of each text)."""
        size_a, size_b = found.sizes
        text = np.repeat(np.arange(len(found.n_a)), found.n_groups)
        many = size_a * size_b > REDUCE
        some = np.flatnonzero(~many)
        links = size_a[some] * size_b[some]
        place = np.arange(links.sum()) - np.repeat(_first(links), links)
        wide = np.repeat(size_b[some], links)
        a = found.a[np.repeat((found.cut_a - size_a)[some], links) + place // wide].astype(np.int64)
        b = found.b[np.repeat((found.cut_b - size_b)[some], links) + place % wide]
        parts = [(np.repeat(text[some], links), a * self.width + b, np.ones(len(a), np.int64))]
        for g in np.flatnonzero(many):
            own, n = np.unique(found.a[found.cut_a[g] - size_a[g] : found.cut_a[g]], return_counts=True)
            other, m = np.unique(found.b[found.cut_b[g] - size_b[g] : found.cut_b[g]], return_counts=True)
            parts.append((np.full(len(own) * len(other), text[g]), (own.astype(np.int64)[:, None] * self.width + other).ravel(), (n[:, None] * m).ravel()))
        where, pair, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(where * (len(self.one.tokens) * self.width) + pair, kind="stable")
        where, pair, n = where[order], pair[order], n[order]
        first = np.flatnonzero((np.diff(where, prepend=-1) != 0) | (np.diff(pair, prepend=-1) != 0))
        n = np.add.reduceat(n, first) if len(first) else n
        texts = len(found.n_a)
        return pair[first], n, np.bincount(where[first], minlength=texts), np.bincount(where[first], n, texts).astype(np.int64)


def _lists(values: np.ndarray, n: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values, kind))


def aligned_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, ids_a, ids_b and the groups' ends cut_a, cut_b (tokens up to the end of each group) of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        aligner = Aligner.read(path_a, path_b)
        for batch in slices(batches, limit=SLICE):
            found = aligner.align(batch.column("text").to_pylist())
            cut_a = found.cut_a - np.repeat(_first(found.n_a), found.n_groups)
            cut_b = found.cut_b - np.repeat(_first(found.n_b), found.n_groups)
            columns = ((found.a, found.n_a), (found.b, found.n_b), (cut_a, found.n_groups), (cut_b, found.n_groups))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(_lists(v, n, pa.int32()) for v, n in columns)], names=["doc_id", "ids_a", "ids_b", "cut_a", "cut_b"])

    lists = ", ".join(f"{c} array<int>" for c in ("ids_a", "ids_b", "cut_a", "cut_b"))
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {lists}")


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def linked_pairs(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, row, n_a, n_b, n_groups, n_links, groups_sha256, pairs (distinct, as numbers) and links (of each pair) of every row."""

    def run(batches):
        aligner = Aligner.read(path_a, path_b)
        for batch in slices(batches, limit=SLICE):
            found = aligner.align(batch.column("text").to_pylist())
            pairs, links, n, total = aligner.pairs(found)
            numbers = [pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_groups, total)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), *numbers, pa.array(aligner.digests(found), pa.string()), _lists(pairs, n, pa.int64()), _lists(links, n, pa.int64())],
                names=["doc_id", "row", *_COUNTS, "groups_sha256", "pairs", "links"],
            )

    numbers = ", ".join(f"{c} long" for c in _COUNTS)
    return with_row(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id long, row long, {numbers}, groups_sha256 string, pairs array<long>, links array<long>")


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """pair, n (rows that hold it) and best (no pair of its A id has more) of all pairs of ``rows``, stored."""
    counts = keep(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a = F.expr(f"pair div {width}").alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))
    return keep(counts.select("pair", "n", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")


def frequent_from(counts: DataFrame, entries: int) -> int:
    """The least power of two such that at most ``entries`` pairs have that count or more; 1 if all pairs fit."""
    bits = F.length(F.bin("n")).alias("bits")
    sizes = {r["bits"]: r["count"] for r in counts.groupBy(bits).count().collect()}
    least, left = max(sizes, default=0) + 1, entries
    while least > 1 and sizes.get(least - 1, 0) <= left:
        least -= 1
        left -= sizes.get(least, 0)
    return 1 << (least - 1)


def link_counts(docs: DataFrame, path_a: str, path_b: str, entries: int = TABLE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs`` (doc_id, text)."""
    rows = keep(linked_pairs(docs, path_a, path_b), "aligned")
    counts = pair_counts(rows, Aligner.read(path_a, path_b).width)
    least = frequent_from(counts, entries)
    table = counts.filter(F.col("n") >= least).toArrow().sort_by("pair")  # at most ``entries`` rows
    shared = rows.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches):
        known, n, best = shared.value
        for batch in batches:
            pairs, links = (batch.column(c).flatten().to_numpy() for c in ("pairs", "links"))
            size = np.diff(batch.column("pairs").offsets.to_numpy()).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), size)
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            at, own, weight = at[hit], row[hit], links[hit]
            total, top = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, own, weight * n[at])
            np.add.at(top, own, weight * best[at])
            left = np.bincount(row[~hit], minlength=batch.num_rows)
            names = ["doc_id", "row", *_COUNTS, "groups_sha256"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(top), pa.array(total), _lists(pairs[~hit], left, pa.int64()), _lists(links[~hit], left, pa.int64())],
                names=[*names, "n_best", "count_sum", "pairs", "links"],
            )

    numbers = ", ".join(f"{c} long" for c in _COUNTS)
    looked = rows.mapInArrow(run, f"doc_id long, row long, {numbers}, groups_sha256 string, n_best long, count_sum long, pairs array<long>, links array<long>")
    wanted = ["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"]
    if least == 1:
        return looked.select(wanted)
    looked = keep(looked, "looked-up")
    missed = looked.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("links").alias("w"))))
    more = missed.join(counts.filter(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("w")).otherwise(0)).alias("top"), F.sum(F.col("w") * F.col("n")).alias("more"))
    done = looked.drop("pairs", "links").join(more, "row", "left")
    add = {"n_best": "top", "count_sum": "more"}
    return done.select([(F.col(c) + F.coalesce(add[c], F.lit(0))).alias(c) if c in add else F.col(c) for c in wanted])
