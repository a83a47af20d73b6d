"""The containment join against Python's own substring test."""

import random

import pytest

from plumbline.operators import containment as C
from plumbline.operators import provenance as PV


def met(frame, *names):
    return sorted(tuple(r[n] for n in names) for r in frame.collect())


@pytest.mark.parametrize("bits", [27, 8])
def test_any_symbol_in_any_text(spark, monkeypatch, bits):
    """Lengths around the anchors, letters of several bytes, texts over several parts; a full filter loses nothing."""
    monkeypatch.setattr(C, "PART", 64)
    monkeypatch.setattr(C, "FILTER_BITS", bits)
    rng = random.Random(7)
    texts = ["".join(rng.choice("abé€ ") for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(40)] + ["", "ab", "ab"]
    symbols = {""}
    for n in (1, 2, 3, 7, 31, 32, 33, 34, 63, 64, 65, 90):
        for _ in range(6):
            source = rng.choice([x for x in texts if len(x) >= n])
            at = rng.randrange(len(source) - n + 1)
            symbols |= {source[at : at + n], source[at : at + n][::-1]}
    wanted = spark.createDataFrame([(s,) for s in [*symbols, *symbols, None]], "symbol string")
    files = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(99, None)], "id long, text string")
    got = met(C.occurrences(wanted, files, keep=["id"]), "id", "symbol")
    assert got == sorted((i, s) for i, x in enumerate(texts) for s in symbols if s in x)


def test_scope_and_empty_tables(spark):
    wanted = spark.createDataFrame([("r", "ab"), ("q", "b"), (None, "a"), ("r", None)], "repo string, symbol string")
    files = spark.createDataFrame([("r", 1, "xabx"), ("q", 2, "xabx"), (None, 3, "ab"), ("r", 4, None)], "repo string, id long, text string")
    assert met(C.occurrences(wanted, files, ["repo"], ["id"]), "repo", "id", "symbol") == [("q", 2, "b"), ("r", 1, "ab")]
    assert C.occurrences(wanted.limit(0), files, ["repo"], ["id"]).columns == ["repo", "id", "symbol"]
    assert C.occurrences(wanted.limit(0), files, ["repo"], ["id"]).isEmpty()
    assert C.occurrences(wanted, files.limit(0), ["repo"], ["id"]).isEmpty()


def test_each_text_is_read_once(spark):
    """More symbols add no scan, no row and no comparison of texts."""
    files = spark.range(20).selectExpr("id", "repeat(concat('name', id, ' '), 50) AS text")
    for count in (10, 2000):
        wanted = spark.range(count).selectExpr("concat('name', id, ' ') AS symbol")
        frame = C.occurrences(wanted, files, keep=["id"])
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Contains" not in plan
        assert len(met(frame, "id", "symbol")) == min(count, 20)


def test_repeated_and_null_symbols_of_a_claim(spark):
    claims = spark.createDataFrame(
        [("a", "r", None, ["x", "x", "z", None]), ("b", "r", "p, q", ["y", "x"]), ("c", "r", "none", ["x"]), ("d", "r", None, None)],
        "source_file string, repository string, reference_path string, claimed_symbols array<string>",
    )
    files = spark.createDataFrame([("r", "p", "x"), ("r", "q", None)], "repository string, path string, content string")
    rows = {r["source_file"]: r for r in PV.verify_claims(claims, files).collect()}
    assert (rows["a"]["verified_symbols"], rows["a"]["missing_symbols"]) == (["x", "x"], ["z"])
    assert (rows["b"]["verified_symbols"], rows["b"]["missing_symbols"], rows["b"]["file_exists"]) == (["x"], ["y"], True)
    assert (rows["c"]["verified_symbols"], rows["c"]["file_exists"], rows["c"]["passed"]) == ([], False, False)
    assert rows["d"]["passed"]
