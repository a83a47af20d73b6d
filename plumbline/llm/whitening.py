"""Embedding whitening on the leading principal components.

A vector's entries become whole numbers x = floor(64 * c) + 1000000. The fit list holds each distinct x vector
once: tasks drop their own repeats before the shuffle, so a vector that fills a third
of the table moves once from each task. Sums, the centred covariance and the check
of the result are one row for each task and dimension, added up by Spark; the driver sees d * d
numbers for d dimensions, however many rows there are. The eigenpairs come from
spectrum slicing (``spectrum``). Whitening is one pass over all rows.

Rows are left out whose vector is null, empty, or holds null or non-finite
entries, and vectors that have not the length most frequent in the fit list (of equally frequent ones the
largest). Entries beyond 2^36 count as 2^36. Repeated rows each get their result, a null vec_id stays
null. Components without variance do not exist: equal vectors, or a table of one, have
none and so no rows. ``deviation`` is null beyond 38 digits. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import keep, slices
from plumbline.llm.spectrum import leading

COMPONENTS, SCALE, OFFSET = 16, 64.0, 1_000_000
#: Largest entry; sums of FLUSH cells stay below 2^63.
LARGEST, FLUSH = 2.0**36, 1 << 20


@dataclass(frozen=True)
class Whitening:
    """n x-vectors with sums ``sums``; ``values`` falling eigenvalues, ``vectors`` their unit vectors as columns, ``trace`` of the covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def cells(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x of the entries of all usable rows, one after the other; the numbers of these rows; their lengths."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    c = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(c))])
    rows = np.flatnonzero((sizes > 0) & (bad[ends] == bad[ends - sizes]))
    with np.errstate(invalid="ignore"):
        x = np.floor(SCALE * np.clip(np.nan_to_num(c), -LARGEST, LARGEST)).astype(np.int64) + OFFSET
    wanted = np.repeat(np.isin(np.arange(len(sizes)), rows), sizes)
    return x[wanted], rows, sizes[rows]


def _as_binary(batches):
    for batch in batches:
        x, _, sizes = cells(batch.column("embedding"))
        offsets = np.concatenate([[0], np.cumsum(sizes) * 8])
        raw = x.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([raw[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary())], names=["x"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([np.frombuffer(x, np.int64) for x in batch.column("x").to_pylist()], np.int64)


def _sums(batches):
    total, seen = None, 0
    for batch in slices(batches, "x"):
        x = _matrix(batch)
        total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
        seen += len(x)
        if seen >= FLUSH - 10_000:
            yield _sum_rows(total, seen)
            total, seen = None, 0
    if seen:
        yield _sum_rows(total, seen)


def _sum_rows(total, seen):
    return pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total), pa.array([seen] * len(total), pa.int64())], names=["i", "s", "n"])


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly: 64-bit numbers, or Python's where these could overflow."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums.tolist()), default=0) < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def squares(d: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    most = int(np.abs(d).max(initial=0))
    if d.dtype != object and most**2 * d.shape[1] < 1 << 62:
        return (d * d).sum(axis=1).tolist()
    if d.dtype != object and most < 1 << 52 and d.shape[1] <= 1 << 9:
        hi, lo = d >> 26, d & ((1 << 26) - 1)
        parts = ((hi * hi).sum(axis=1), (hi * lo).sum(axis=1), (lo * lo).sum(axis=1))
        return [(a << 52) + (b << 27) + c for a, b, c in zip(*(p.tolist() for p in parts), strict=True)]
    return [sum(v * v for v in row) for row in d.tolist()]


def _products(shared):
    """Tasks' sums of products of the vectors, centred and projected on ``vectors`` (none: as they are), a row for each dimension."""

    def run(batches):
        n, sums, vectors = shared.value
        total = None
        for batch in slices(batches, "x"):
            y = centred(_matrix(batch), n, sums).astype(np.float64) / n
            y = y if vectors is None else y @ vectors
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    return run


def _covariance(fit: DataFrame, n: int, sums: np.ndarray, vectors: np.ndarray | None, d: int) -> np.ndarray:
    shared = fit.sparkSession.sparkContext.broadcast((n, sums, vectors))  # d * d numbers at most
    rows = fit.mapInArrow(_products(shared), "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    added = rows.filter("i <= j").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((d, d))
    i, j, v = (added.column(c).to_numpy() for c in ("i", "j", "v"))
    out[i, j] = out[j, i] = v / n
    return out


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The model of ``rows`` (embedding), or None without a usable vector."""
    fit = keep(rows.select("embedding").mapInArrow(_as_binary, "x binary").distinct(), "vectors")
    size = F.length("x")
    common = fit.groupBy(size.alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return None
    fit, d = fit.filter(size == common["size"]), common["size"] // 8
    s = F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    found = sorted(fit.mapInArrow(_sums, "i int, s long, n long").groupBy("i").agg(s, F.sum("n").alias("n")).collect())
    n, sums = found[0]["n"], np.array([int(r["s"]) for r in found], object)
    v = _covariance(fit, n, sums, None, d)
    values, vectors = leading(v, components)
    error = 0.0
    if len(values):
        error = float(np.abs(_covariance(fit, n, sums, vectors / np.sqrt(values), len(values)) - np.eye(len(values))).max())
    return Whitening(n, sums, values, vectors, float(np.trace(v)), error)


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation decimal(38,0) and whitened array<double> (a number for each component) of all usable rows (vec_id, embedding)."""
    shared = rows.sparkSession.sparkContext.broadcast((model.n, model.sums, model.vectors / np.sqrt(model.values)))

    def run(batches):
        n, sums, vectors = shared.value
        for batch in batches:
            x, at, sizes = cells(batch.column("embedding"))
            fits = sizes == len(sums)
            x, at = x[np.repeat(fits, sizes)].reshape(-1, len(sums)), at[fits]
            d = centred(x, n, sums)
            deviation = pa.array([Decimal(v) if v < 10**38 else None for v in squares(d)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(at)), deviation, pa.array(list(d.astype(np.float64) / n @ vectors), pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "whitened"],
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def whitened_components(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row and component."""
    model = fit_whitening(rows, components)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if model is None or not len(model.values):
        empty = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], empty)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.values))
    each = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
