"""Token counts by a two-tier lookup on the map side.

A text's tokens never cross the start of a run of blanks in the tokenizer's
vocabulary (checked when the model is read), so a text is the sum of its
pre-tokens. A first pass gathers the frequent pre-tokens: every task keeps a
bounded summary of its own and only these summaries are merged. The merged
table, pre-token to number of tokens, is broadcast (TABLE entries at most).
The second pass looks pre-tokens up there, then in a cache of the worker, and
encodes only what neither holds. No pre-token is shuffled, and the counts do not
depend on what the table holds.

Null counts as the empty text, which has no tokens. Rows are counted one by
one, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, utf8

#: Entries of the broadcast table, of one task's summary, and of a worker's cache; longest pre-token (bytes) that is kept in them.
TABLE, SUMMARY, CACHE, LONGEST = 32768, 8192, 400_000, 48
LIMIT = 4096

_BLANK = "▁".encode()
#: Pieces of the vocabulary hold neither a blank after another character, nor line ends or tabs next to one.
_PRE_TOKEN = re.compile(rb" *[^ \n\t]+| +|[\n\t]")

_tools: dict = {}


def pre_tokens(text: bytes) -> list[bytes]:
    """What the tokenizer sees, cut where no token can cross; the leading blank is its own."""
    if not text:
        return []
    return _PRE_TOKEN.findall(b" " + (text.replace(_BLANK, b" ") if _BLANK in text else text))


def load(path: str):
    """The model without its leading blank, which ``pre_tokens`` has put there; kept for the worker's life."""
    if path not in _tools:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        crossing = [p.piece for p in proto.pieces if re.search("[^▁]▁|.[\n\t]|[\n\t].", p.piece, re.S)]
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or crossing:
            raise ValueError(f"{path}: its tokens may cross pre-tokens {crossing[:3]}")
        spec.add_dummy_prefix = False
        _tools[path] = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), {}
    return _tools[path]


def _lengths(model, words: list[bytes]) -> list[int]:
    return [len(ids) for ids in model.encode([w.decode() for w in words], num_threads=1)]


def _frequent(batches):
    seen: Counter = Counter()
    for batch in slices(batches):
        for text in utf8(batch):
            seen.update(pre_tokens(text))
        if len(seen) > 20 * SUMMARY:
            seen = Counter(dict(heapq.nlargest(10 * SUMMARY, seen.items(), key=lambda x: x[1])))
    best = [x for x in heapq.nlargest(SUMMARY, seen.items(), key=lambda x: x[1]) if len(x[0]) <= LONGEST]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.binary()), pa.array([n for _, n in best], pa.int64())], names=["word", "n"])


def frequent_words(docs: DataFrame, entries: int = TABLE) -> list[bytes]:
    """At most ``entries`` pre-tokens, the most frequent by the tasks' summaries."""
    merged = docs.select("text").mapInArrow(_frequent, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in merged.orderBy(F.desc("n"), "word").limit(entries).select("word").collect()]


def token_counts(docs: DataFrame, model_path: str, entries: int = TABLE) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of ``docs`` (doc_id, text) under the model file, which every worker has."""
    model, _ = load(model_path)
    words = frequent_words(docs, entries)
    table = docs.sparkSession.sparkContext.broadcast(dict(zip(words, _lengths(model, words), strict=True)))

    def run(batches):
        frequent = table.value
        model, cache = load(model_path)
        for batch in slices(batches):
            texts = utf8(batch)
            parts = [pre_tokens(t) for t in texts]
            missed = {w for p in parts for w in p if w not in frequent and w not in cache}
            if len(cache) + len(missed) > CACHE:
                cache.clear()
                missed = {w for p in parts for w in p if w not in frequent}
            own = list(missed)
            fresh = dict(zip(own, _lengths(model, own), strict=True))
            second = {**cache, **fresh} if len(fresh) > CACHE else cache
            if second is cache:
                cache.update(fresh)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([sum(frequent[w] if w in frequent else second[w] for w in p) for p in parts], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )
            for w in own:
                if len(w) > LONGEST:
                    cache.pop(w, None)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
