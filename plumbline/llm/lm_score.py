"""LM scoring: prediction by partial matching over bytes, next to a smoothed word count.

The model holds contexts of up to ORDER symbols (bytes, and one sign for the end
of a text; a start sign fills the contexts of the first bytes). It is
pretrained: all n-grams of the texts are counted in the tasks and
summed by a shuffle; shorter contexts are sums of longer ones. A symbol that a
context has seen gets count / (all + kinds); what is left over is the escape to the
context without its first symbol (method C). Symbols that the longer context has seen are
excluded there, their counts leave the shorter one's sum. Below the empty
context all symbols that are left are equally likely.

No node is left out. What a symbol costs depends on its n-gram alone, so each
distinct n-gram of the texts gets its code length once, in stored tables that are
built from the empty context up by joins (``code_lengths``): an n-gram meets the
one without its first symbol, and at most SYMBOLS of them share a context. Of
these code lengths those of the most frequent n-grams, NODES at most, are
broadcast; all others of a document meet theirs in a join.

Word counts stay exact and whole: the TABLE most frequent words are broadcast
with their counts, all other words of a document meet theirs in a join.

Null is the empty text (one end). Without training texts all symbols are equally
likely, and the word score is 0 where V is 0. Repeated rows are scored one by
one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import keep, slices, utf8, with_row

ORDER, NODES = 4, 500_000
TABLE, PENDING = 100_000, 200_000
#: Bytes of text that a worker codes together; each takes some forty bytes in arrays.
SLICE = 1 << 20
#: Symbols: bytes, the end of a text, and the sign that fills contexts before it.
END, START, SYMBOLS = 256, 257, 257
_BITS = 9

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def coded(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the texts one after the other, each with start signs before and its end; places that are scored."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    total = np.cumsum(sizes + order + 1)
    out = np.full(int(total[-1]) if len(texts) else 0, START, np.int64)
    first = total - sizes - 1
    scored = np.zeros(len(out), bool)
    places = np.arange(len(joined)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
    out[places] = joined
    out[total - 1] = END
    scored[places] = True
    scored[total - 1] = True
    return out, np.flatnonzero(scored)


def grams(symbols: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The symbol at each place with ``order`` symbols before it, as one number; the symbol itself in the last bits."""
    out = symbols[at].copy()
    for i in range(1, order + 1):
        out |= symbols[at - i] << (_BITS * i)
    return out


def _gram_counts(order: int):
    def run(batches):
        held_keys, held_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in slices(batches, limit=SLICE):
            texts = utf8(batch)
            symbols, at = coded(texts, order)
            learnt = batch.column("learnt").to_numpy(zero_copy_only=False).astype(np.int64)
            marked = grams(symbols, at, order) << 1 | np.repeat(learnt, [len(t) + 1 for t in texts])
            fresh, n = np.unique(marked, return_counts=True)
            keys, place = np.unique(np.concatenate([held_keys, fresh]), return_inverse=True)
            held_n = np.bincount(place, np.concatenate([held_n, n]), len(keys)).astype(np.int64)
            held_keys = keys
            if len(held_keys) > 4 * PENDING:
                yield _counts(held_keys, held_n)
                held_keys, held_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield _counts(held_keys, held_n)

    return run


def _counts(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    learnt = np.where(keys & 1, n, 0)
    return pa.RecordBatch.from_arrays([pa.array(keys >> 1, pa.int64()), pa.array(learnt, pa.int64()), pa.array(n, pa.int64())], names=["gram", "n", "uses"])


@dataclass
class Table:
    """Numbers found by 64-bit keys through open addressing."""

    keys: np.ndarray
    values: np.ndarray
    shift: np.uint64

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        bits = max(4, int(2 * len(keys)).bit_length())
        table = cls(np.full(1 << bits, -1, np.int64), np.zeros(1 << bits), np.uint64(64 - bits))
        slots, left, mask = table._slots(keys), np.arange(len(keys)), (1 << bits) - 1
        while len(left):
            at = slots[left]
            free = table.keys[at] < 0
            places, first = np.unique(at[free], return_index=True)
            placed = left[free][first]
            table.keys[places], table.values[places] = keys[placed], values[placed]
            stay = np.ones(len(left), bool)
            stay[np.flatnonzero(free)[first]] = False
            left = left[stay]
            slots[left] = (slots[left] + 1) & mask
        return table

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) for each key."""
        slots = self._slots(keys)
        held = self.keys[slots]
        found = held == keys
        values = self.values[slots]
        left = np.flatnonzero(~found & (held >= 0))
        mask = len(self.keys) - 1
        while len(left):
            slots[left] = (slots[left] + 1) & mask
            held = self.keys[slots[left]]
            hit = held == keys[left]
            found[left[hit]] = True
            values[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (held >= 0)]
        return found, values


def code_lengths(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, uses, code: the log10 of the probability of each n-gram's last symbol, for all n-grams of ``texts`` (text, learnt).

    Counts are those of the rows with ``learnt``; uses counts the n-gram in all rows.
    """
    counted = texts.select("text", "learnt").mapInArrow(_gram_counts(order), "gram long, n long, uses long")
    sums = [F.sum("n").alias("n"), F.sum("uses").alias("uses")]
    levels = [keep(counted.groupBy("gram").agg(*sums), "grams")]
    for level in range(order - 1, -1, -1):
        levels.append(keep(levels[-1].groupBy(_shorter(level).alias("gram")).agg(*sums), "grams"))
    codes = None
    for level, nodes in enumerate(levels[::-1]):
        codes = keep(_coded_level(nodes, level, codes), "codes")
    return codes.select("gram", "uses", F.col("plain").alias("code"))


def _shorter(level: int):
    """The last ``level`` + 1 symbols of an n-gram."""
    return F.col("gram").bitwiseAND(F.lit((1 << (_BITS * (level + 1))) - 1))


def _coded_level(nodes: DataFrame, level: int, shorter: DataFrame | None) -> DataFrame:
    """gram, n, uses, total, kinds, plain, escaped of the n-grams with contexts of ``level`` symbols.

    total and kinds belong to the context. plain is the code length where the context is
    entered without an escape, escaped the one of all that follows an escape from it.
    """
    context = Window.partitionBy(F.shiftright("gram", _BITS))
    seen = F.col("n") > 0
    if shorter is not None:
        short = shorter.select(F.col("gram").alias("short"), *(F.col(c).alias(f"s_{c}") for c in ("n", "total", "kinds", "plain", "escaped")))
        nodes = nodes.withColumn("short", _shorter(level - 1)).join(short, "short")
    nodes = nodes.withColumn("total", F.sum("n").over(context)).withColumn("kinds", F.count(F.when(seen, 1)).over(context))
    if shorter is None:
        left = F.lit(SYMBOLS) - F.col("kinds")
        nodes = nodes.withColumn("escaped", F.when(left > 0, -F.log10(left)).otherwise(F.lit(0.0))).withColumn("s_plain", F.col("escaped"))
    else:
        # What the shorter context has left once the symbols of this one are excluded.
        nodes = nodes.withColumn("left_kinds", F.col("s_kinds") - F.col("kinds"))
        nodes = nodes.withColumn("left", F.col("s_total") - F.coalesce(F.sum(F.when(seen, F.col("s_n"))).over(context), F.lit(0)) + F.col("left_kinds"))
        further = F.when(F.col("left_kinds") > 0, F.log10(F.col("left_kinds") / F.col("left"))).otherwise(F.lit(0.0)) + F.col("s_escaped")
        nodes = nodes.withColumn("escaped", F.when(F.col("s_n") > 0, F.log10("s_n") - F.log10(F.greatest("left", F.lit(1)))).otherwise(further))
    whole = F.col("total") + F.col("kinds")
    plain = F.when(seen, F.log10(F.col("n") / whole)).when(F.col("kinds") > 0, F.log10(F.col("kinds") / whole) + F.col("escaped")).otherwise(F.col("s_plain"))
    return nodes.select("gram", "n", "uses", "total", "kinds", plain.alias("plain"), "escaped")


def frequent_codes(codes: DataFrame, nodes: int = NODES) -> Table:
    """The code lengths of the most used n-grams, at most ``nodes``: as many whole classes of about equal use as fit."""
    size = F.floor(F.log2("uses") * 16).alias("size")
    least, held = None, 0
    for row in codes.groupBy(size).count().orderBy(F.desc("size")).collect():  # 16 rows at most for each power of two
        held += row["count"]
        if held > nodes:
            break
        least = row["size"]
    if least is None:
        return Table.build(np.zeros(0, np.int64), np.zeros(0))
    table = codes.filter(size >= least).select("gram", "code").toArrow()  # ``nodes`` rows at most
    return Table.build(table.column("gram").to_numpy(), table.column("code").to_numpy())


def tokens(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def _word_counts(batches):
    seen: Counter = Counter()
    for batch in slices(batches, limit=SLICE):
        for text in utf8(batch):
            seen.update(tokens(text))
        if len(seen) > PENDING:
            yield _words(seen)
            seen = Counter()
    yield _words(seen)


def _words(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])


def _lists(owner: np.ndarray, keys: np.ndarray, n_rows: int) -> pa.Array:
    """For each row its distinct keys with how often they stand; owner: the row of each key, in ascending order."""
    order = np.lexsort((keys, owner))
    keys = keys[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))[: len(keys)])
    n = np.diff(np.append(first, len(keys)))
    offsets = np.searchsorted(owner[first], np.arange(n_rows + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(keys[first], pa.int64()), pa.array(n, pa.int64())], names=["gram", "n"]))


def _scored(shared, order: int):
    def run(batches):
        codes, frequent = shared.value
        for batch in slices(batches, limit=SLICE):
            texts = utf8(batch)
            full = grams(*coded(texts, order), order)
            sizes = np.array([len(t) + 1 for t in texts], np.int64)
            held, bits = codes.get(full)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            missing = np.flatnonzero(~held)
            others = _lists(np.searchsorted(first, missing, "right") - 1, full[missing], len(texts))
            n_tokens, known, base, other = [], [], [], []
            for text in texts:
                words = Counter(tokens(text))
                n_tokens.append(sum(words.values()) + 1)
                rare = [(w, n) for w, n in words.items() if w not in frequent]
                both = [(n, frequent[w]) for w, n in words.items() if w in frequent]
                known.append(sum(n for n, _ in both))
                base.append(sum(n * c for n, c in both))
                other.append([{"word": w, "n": n} for w, n in rare])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(n_tokens, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(other, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))),
                    pa.array(np.add.reduceat(np.where(held, bits, 0.0), first), pa.float64()),
                    others,
                ],
                names=["doc_id", "held_out", "n_tokens", "known", "base", "other", "held_score", "other_grams"],
            )

    return run


_SCORED = (
    "doc_id long, held_out boolean, n_tokens long, known long, base double, other array<struct<word: binary, n: long>>, "
    "held_score double, other_grams array<struct<gram: long, n: long>>"
)


def lm_scores(docs: DataFrame, held_out, order: int = ORDER, nodes: int = NODES, table: int = TABLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    held_out: a boolean column; rows where it holds are not learnt from.
    base_score sums log10((c + 1) / (N + V + 1)) over the tokens, one end for each
    text among them: c counts the token, N all and V the distinct training tokens.
    nodes, table: n-grams and words that are broadcast at most; they change nothing but speed.
    """
    texts = docs.select("doc_id", "text", held_out.alias("held_out"))
    training = texts.filter(~F.col("held_out"))
    codes = code_lengths(texts.select("text", F.coalesce(~F.col("held_out"), F.lit(False)).alias("learnt")), order)
    counts = keep(training.select("text").mapInArrow(_word_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    n_texts = training.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] + n_texts, total["v"] + (1 if n_texts else 0)
    best = counts.orderBy(F.desc("c"), "word").limit(table).toArrow()
    frequent = dict(zip(best.column("word").to_pylist(), np.log10(best.column("c").to_numpy() + 1.0).tolist(), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast((frequent_codes(codes, nodes), frequent))  # ``nodes`` and ``table`` entries at most
    rows = keep(with_row(texts.mapInArrow(_scored(shared, order), _SCORED)), "scored")
    other = rows.select("row", F.explode("other").alias("o")).select("row", F.col("o.word").alias("word"), F.col("o.n").alias("n"))
    # The rare side of the table: no word of it is more frequent than the table's last.
    found = other.join(counts, "word").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("sum"))
    grams_ = rows.select("row", F.explode("other_grams").alias("o")).select("row", F.col("o.gram").alias("gram"), F.col("o.n").alias("n"))
    rest = grams_.join(codes, "gram").groupBy("row").agg(F.sum(F.col("n") * F.col("code")).alias("rest"))
    each = math.log10(n + v + 1)
    return rows.join(found, "row", "left").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(1 if n_texts else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("sum", F.lit(0.0)) + F.lit(math.log10(n_texts + 1)) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        (F.col("held_score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )

