"""Stored jobs hand their Python workers a few megabytes at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from plumbline import session
from plumbline.llm import common

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_workers_get_small_batches_of_stored_jobs(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    rows = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))
    before = spark.conf.get(BOUND)
    seen = rows.mapInArrow(sizes, "n long, size long")
    for store in (session.stored, common.keep, lambda df, label: common.settled(spark, lambda: df, label)):
        got = store(seen, "sizes").collect()
        assert sum(r["n"] for r in got) == 6000 and max(r["size"] for r in got) < 2 * session.BATCH_BYTES
    assert spark.conf.get(BOUND) == before and BOUND not in spark.conf.getAll


def test_a_bound_of_the_session_holds(spark):
    spark.conf.set(BOUND, "1m")
    try:
        with session.small_batches(spark):
            assert spark.conf.get(BOUND) == "1m"
        assert spark.conf.get(BOUND) == "1m"
    finally:
        spark.conf.unset(BOUND)


def test_a_worker_keeps_the_cache_of_one_operator():
    one, two = {"a": 1}, {}
    assert common.own_cache(one) is one and common.own_cache(one) == {"a": 1}
    assert common.own_cache(two) is two and not one
    common.own_cache({})
