"""Whitening against a plain version in numpy, and spectrum slicing against its eigenvalues."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import queries, spectrum, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=16):
    """{vec_id: (deviation, whitened)}, n, explained; the usual eigenvalue routine instead of slicing."""
    usable = [(i, np.array(v, np.float32)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {j: [math.floor(64 * float(c)) + 1_000_000 for c in v] for j, (_, v) in enumerate(usable)}
    fit = sorted(set(map(tuple, x.values())))
    n, s = len(fit), [sum(column) for column in zip(*fit, strict=True)]
    y = np.array([[(n * a - b) / n for a, b in zip(v, s, strict=True)] for v in fit])
    v = y.T @ y / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    keep = e > 1e-9 * np.trace(v)
    e, w = e[keep], w[:, keep]
    out = []
    for j, (i, _) in enumerate(usable):
        d = [n * a - b for a, b in zip(x[j], s, strict=True)]
        out.append((i, sum(c * c for c in d), np.array(d) / n @ w / np.sqrt(e)))
    return out, n, e / np.trace(v)


def held_against_plain(got, rows):
    want, n, explained = plain(rows)
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    k = len(explained)
    assert len(got) == k * len(want)
    for c in range(k):
        assert abs(got[0]["explained"] - explained[got[0]["component"] - 1]) < 1e-9
        sign = np.sign(sum(by[i, c + 1][0]["whitened"] * w[c] for i, _, w in want))
        for i, deviation, w in want:
            for r in by[i, c + 1]:
                assert r["deviation"] == deviation and abs(r["whitened"] * sign - w[c]) < 1e-6 and abs(r["explained"] - explained[c]) < 1e-9


def awkward_rows():
    rng = np.random.default_rng(3)
    spread = np.linspace(3, 0.2, 20)
    rows = [(i, (rng.standard_normal(20) * spread).astype(np.float32).tolist()) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    rows += [(0, rows[0][1]), (70, rows[5][1]), (None, rows[1][1]), (71, None), (72, []), (73, [None] * 20), (74, [nan] + [0.0] * 19), (75, [0.0] * 19 + [-inf])]
    return rows + [(80 + i, rows[9][1]) for i in range(40)]


def test_whitening_is_the_plain_one(spark):
    rows = awkward_rows()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5).selectExpr("*", "'clash' AS x", "1 AS component", "2 AS whitened")
    held_against_plain(whitening.whitened_components(df).collect(), [(i, v) for i, v in rows])


def test_query_on_the_given_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    held_against_plain(queries.op11_whitening(spark, sf).collect(), rows)


def test_tables_without_variance_or_rows(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None, 0)], [(1, [0.5, 1.0], 0)], [(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 1)]):
        done = whitening.whitened_components(spark.createDataFrame(rows, SCHEMA))
        assert done.columns == columns and done.count() == 0


def test_fewer_dimensions_than_components_and_other_lengths(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.5]), (3, [-1.0, 2.0]), (4, [9.0])]
    got = whitening.whitened_components(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    held_against_plain(got, rows[:3])


def test_sums_of_squares_are_exact_at_every_size():
    for most, dims in ((3, 4), (1 << 30, 64), (1 << 40, 700), (1 << 51, 64), (1 << 61, 3)):
        d = np.random.default_rng(1).integers(-most, most, (5, dims))
        assert whitening.squares(d) == [sum(v * v for v in row) for row in d.tolist()]
    x = np.array([[1 << 40, -5]])
    assert whitening.centred(x, 1 << 30, np.array([7, -9], object)).tolist() == [[(1 << 70) - 7, -5 * (1 << 30) + 9]]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(0, 10**6), st.sampled_from(["spread", "ties", "low rank", "near ties"]))
def test_slicing_finds_the_leading_pairs(d, seed, kind):
    rng = np.random.default_rng(seed)
    e = rng.random(d) ** 4
    if kind == "ties":
        e = np.round(e, 1)
    elif kind == "low rank":
        e[d // 3 :] = 0
    elif kind == "near ties":
        e = 1 + np.arange(d) * 10.0 ** -rng.integers(6, 14)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    shift = float(rng.choice(e)) + 0.01
    assert spectrum.negatives(a - shift * np.eye(d)) == (np.linalg.eigvalsh(a) < shift).sum()
    values, vectors = spectrum.leading(a, 8)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][: len(values)]
    assert len(values) == min(8, (e > 1e-12).sum())
    assert np.abs(values - want).max(initial=0) < 1e-12 * max(1, e.max()) and np.all(np.diff(values) <= 1e-12)
    assert np.abs(a @ vectors - vectors * values).max(initial=0) < 1e-12 and np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-12


@pytest.mark.parametrize(("d", "seed", "kind"), [(13, 0, "near ties"), (2, 0, "ties"), (7, 7, "ties"), (5, 0, "low rank"), (11, 7, "low rank")])
def test_slicing_tells_neighbours_of_a_slice_and_zeros_apart(d, seed, kind):
    """Eigenvalues next to a cluster are not taken for its own, and a cut at 0 does not meet those of a matrix of low rank."""
    test_slicing_finds_the_leading_pairs.hypothesis.inner_test(d, seed, kind)


def test_a_matrix_that_is_not_finite_is_refused():
    with pytest.raises(ValueError):
        spectrum.leading(np.array([[np.nan]]), 1)
