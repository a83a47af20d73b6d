"""Quality classifier: compressed size under a dictionary of good and one of bad text.

Two zstandard dictionaries are trained, one from text labelled good and one
from text labelled bad. A text is cut into blocks of BLOCK bytes, so the
dictionaries matter for long texts as well, and every block is compressed with
either. The normalised difference of the two sums says which kind of text this
is; a logistic curve fitted on labelled texts that no dictionary has seen turns
it into a probability. A second input of that curve says how short the text
is, as a few words hold little evidence either way.

The fit takes at most SAMPLE labelled texts of each label (chosen by a hash of
the id) and at most BLOCKS blocks of each, a documented bound; scoring reads
every block of every text. A null or empty text is scored as an empty one.
Without labels of both kinds every text gets the share of good labels, or 0.5.
Labels that are null or whose document is missing are left out. Rows are
scored one by one, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, utf8

SAMPLE, BLOCKS, BLOCK = 3000, 24, 512
DICTIONARY_BYTES, LEVEL = 512 << 10, 3
THRESHOLD = 0.7


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries of bad and good text, and the weights of the curve; no dictionaries: a constant score."""

    dictionaries: tuple[bytes, bytes] | None
    weights: tuple[float, ...]

    def score(self, bad: int, good: int, n_bytes: int) -> float:
        z = float(np.dot(self.weights, features(bad, good, n_bytes)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(bad: int, good: int, n_bytes: int) -> tuple[float, float, float]:
    return 1.0, (bad - good) / max(1, bad + good), 64 / (64 + n_bytes)


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def compressors(dictionaries: Sequence[bytes]) -> list:
    out = []
    for content in dictionaries:
        shared = zstandard.ZstdCompressionDict(content)
        shared.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_dict_id=False))
    return out


def compressed_sizes(text: bytes, tools: list) -> tuple[int, ...]:
    """Bytes of all blocks under each dictionary, without what an empty block takes."""
    parts = blocks(text)
    return tuple(sum(len(tool.compress(b)) for b in parts) - len(parts) * len(tool.compress(b"")) for tool in tools)


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:].ljust(8, b" ")


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a slight penalty."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [1e-3] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _spread(text: bytes) -> list[bytes]:
    parts = blocks(text)
    return [parts[i * len(parts) // BLOCKS] for i in range(BLOCKS)] if len(parts) > BLOCKS else parts


def _sampled(batches):
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays(
            [batch.column("quality"), pa.array([_spread(t) for t in utf8(batch)], pa.list_(pa.binary()))], names=["quality", "blocks"]
        )


def _sizes(dictionaries):
    def run(batches):
        tools = compressors(dictionaries)
        for batch in slices(batches):
            texts = utf8(batch)
            both = [compressed_sizes(t, tools) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("quality")] + [pa.array(v, pa.int64()) for v in ([b for b, _ in both], [g for _, g in both], [len(t) for t in texts])],
                names=["quality", "bad", "good", "n_bytes"],
            )

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), of which at most ``sample`` a label are used."""
    rank = F.xxhash64("doc_id")
    known = labels.select("doc_id", "quality").filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    chosen = None
    for quality in (0, 1):
        part = known.filter(F.col("quality") == quality).orderBy(rank, "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    rows = [(r["doc_id"], r["quality"], bool(r["half"])) for r in chosen.withColumn("half", F.pmod(rank, F.lit(2)) == 1).collect()]
    spark = docs.sparkSession
    share = sum(q for _, q, _ in rows) / len(rows) if rows else 0.5
    constant = QualityModel(None, (math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0))
    if len({q for _, q, _ in rows}) < 2:
        return constant
    # At most 2 * sample rows of three numbers: that bound is what makes this broadcast safe.
    picked = F.broadcast(spark.createDataFrame(rows, "doc_id long, quality int, half boolean"))
    texts = docs.select("doc_id", "text").join(picked, "doc_id").select("text", "quality", "half")
    learnt = texts.filter("half").mapInArrow(_sampled, "quality int, blocks array<binary>").toArrow().to_pylist()
    groups = [[b for r in learnt if r["quality"] == q for b in r["blocks"]] for q in (0, 1)]
    if not all(groups):
        return constant
    dictionaries = (dictionary(groups[0]), dictionary(groups[1]))
    seen = texts.filter("NOT half").mapInArrow(_sizes(dictionaries), "quality int, bad long, good long, n_bytes long").toArrow().to_pylist()
    if len({r["quality"] for r in seen}) < 2:
        return constant
    x = np.array([features(r["bad"], r["good"], r["n_bytes"]) for r in seen])
    return QualityModel(dictionaries, fit_curve(x, np.array([r["quality"] for r in seen], float)))


def score_text(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """``docs`` with the score as a column ``name``; a column of that name is replaced."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES at most

    def run(batches):
        own = shared.value
        tools = compressors(own.dictionaries) if own.dictionaries else None
        for batch in slices(batches):
            scores = []
            for text in utf8(batch):
                bad, good = compressed_sizes(text, tools) if tools else (0, 0)
                scores.append(own.score(bad, good, len(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    return docs.mapInArrow(run, schema)
