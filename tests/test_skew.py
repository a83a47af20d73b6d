"""Tables in which one key holds a third of the rows: results stay whole."""

import pytest
from tables import first, rows_by

from plumbline.operators import assertions as A
from plumbline.operators import audit as AU
from plumbline.operators import joins, pairs
from plumbline.operators.aggregates import duplicates
from plumbline.operators.compare import cellwise, multiset_difference
from plumbline.operators.percentiles import exact_percentiles
from plumbline.operators.suites import Suite, run_suite

ROWS = 30_000


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hot") / "t")
    spark.range(ROWS).selectExpr(
        "id",
        "case when id % 3 = 0 then 'hot' else concat('k', id % 5000) end as key",
        "case when id % 7 = 0 then null else cast(pmod(id * 31, 1009) as double) end as v",
        "concat('g', id % 4) as g",
    ).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def con(hot):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE TABLE t AS SELECT * FROM '{hot.inputFiles()[0].rsplit('/', 1)[0].removeprefix('file://')}/*.parquet'")
    return con


def one(con, sql):
    return con.execute(sql).fetchall()[0]


def test_orphans_of_a_hot_key(spark, hot, con):
    parents = spark.range(0, 5000, 2).selectExpr("concat('k', id) as pk")
    got = joins.orphan_keys(hot, "key", parents, "pk")
    want = dict(con.execute("SELECT key, count(*) FROM t WHERE key = 'hot' OR key[2:]::INT % 2 = 1 GROUP BY 1").fetchall())
    assert {r["key"]: r["child_rows"] for r in got.collect()} == want and want["hot"] == ROWS // 3
    sliced = joins.orphan_keys(hot, "key", parents, "pk", by=["g"])
    assert sliced.groupBy().sum("child_rows").first()[0] == sum(want.values())


def test_pairs_are_counted_not_built(hot):
    """The hot key alone makes 10^8 pairs."""
    row = first(joins.joined_pairs(hot, hot, "key"))
    assert row["pairs"] > (ROWS // 3) ** 2


def test_duplicates(hot, con):
    row = first(duplicates(hot, ["key", "g"]))
    want = one(con, "SELECT count(*) FILTER (WHERE n > 1), sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM t GROUP BY key, g)")
    assert (row["duplicate_groups"], row["duplicate_rows"]) == want


def test_percentiles_by_hot_group(hot, con):
    wanted = {"p50": 0.5, "p99": 0.99}
    got = {r["key"]: (r["p50"], r["p99"]) for r in exact_percentiles(hot, "v", wanted, ["key"]).collect()}
    want = con.execute("SELECT key, quantile_cont(v, 0.5), quantile_cont(v, 0.99) FROM t WHERE v IS NOT NULL GROUP BY 1").fetchall()
    assert len(got) == len(want)
    for key, p50, p99 in want:
        assert got[key] == pytest.approx((p50, p99))


def test_comparison(spark, hot):
    assert first(multiset_difference(hot, hot.repartition(5, "g")))["equal"]
    changed = hot.selectExpr("id", "key", "case when id = 3 then -1 else v end as v", "g")
    assert first(multiset_difference(hot, changed)) == {"only_base": 1, "only_other": 1, "equal": False}
    assert cellwise(hot, changed, ["id"], ["v"]).where("change <> 'same'").count() == 1


def test_population_over_hot_entity(spark, hot, con):
    source = hot.withColumnRenamed("key", "customer_id")
    target = source.select("customer_id")
    suite = Suite("s", [A.Population("p", "src", "v < 500", "customer_id"), A.Unique("u", ("customer_id",))])
    row = rows_by(run_suite(target, suite, {"src": source}), "name")["p"]
    want = one(
        con,
        "WITH b AS (SELECT key, count(*) AS n FROM t WHERE NOT v < 500 GROUP BY 1), a AS (SELECT key, count(*) AS n FROM t GROUP BY 1) "
        "SELECT sum(a.n * b.n)::BIGINT, count(*) FROM a JOIN b USING (key)",
    )
    assert (row["violations"], row["observed"]) == want


def test_hot_prompt_and_hash(hot, con):
    df = hot.selectExpr(
        "cast(id as string) as example_id", "key as evidence_hash", "key as prompt", "g as chosen_sql", "'x' as rejected_sql",
        "'1' as contract_version", "'f' as fixture_id", "id",
    )
    row = first(pairs.audit_integrity(df, order="id"))
    want = one(
        con,
        "WITH f AS (SELECT key, arg_min(g, id) AS g FROM t GROUP BY 1) SELECT (SELECT count(*) - count(DISTINCT key) FROM t), "
        "(SELECT count(*) FROM t JOIN f USING (key) WHERE t.g <> f.g)",
    )
    assert (row["duplicate_evidence_hashes"], row["conflicting_preference_labels"]) == want


def test_one_tenant_holds_the_log(spark):
    """A chain of one hot tenant is built and verified in bounded segments."""
    df = spark.range(3000).selectExpr(
        "concat('e', id) as event_id",
        "case when id < 2800 then id + 1 else id - 2799 end as sequence_num",
        "case when id < 2800 then 'hot' else 'cold' end as tenant_id",
        *[f"cast(null as string) as {c}" for c in ("client_id", "decision", "domain", "key_id", "method", "metric_id", "resource_uri", "sql_sha256", "tool_name")],
        "cast(id as double) as latency_ms",
        "cast(id as double) as timestamp_utc",
    )
    chain = AU.build_chain(df, 50)
    assert chain.count() == 3000 and AU.verify_chain(chain, 50).count() == 0
    assert AU.verify_chain(chain.where("sequence_num <> 777 or tenant_id = 'cold'"), 50).count() == 1
