"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is written to the noop sink, so all rows and columns are computed.
``pairs`` holds the same work done the naive way, one scan per assertion, probe
or variant, next to the fused form.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))

HEADLINE = (
    "as_suite",
    "m_net_revenue",
    "m_mau",
    "m_retention",
    "m_readmission",
    "pb_all",
    "pb_by_slice",
    "pf_score",
    "cmp_multiset",
    "cmp_cellwise",
    "var_all",
    "hs_kill_matrix",
    "hs_catch",
    "gv_compliance",
    "gv_drift",
    "gv_stats",
    "tj_scorecard",
    "tj_replay",
    "pd_audit_integrity",
    "au_chain_build",
    "au_chain_verify",
    "pv_verify",
    "agg_percentile",
)


def session():
    from plumbline.session import build_session

    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "12g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(make) -> None:
    frames = make()
    for df in frames if isinstance(frames, list) else [frames]:
        df.write.format("noop").mode("overwrite").save()


def timed(make) -> float:
    """Median of the repeats after one warm-up."""
    run(make)
    times = []
    for _ in range(REPEATS):
        started = time.perf_counter()
        run(make)
        times.append(time.perf_counter() - started)
    return round(statistics.median(times), 3)


def naive_pairs(spark):
    """label -> (naive, fused): the same rows, one scan per check against one scan."""
    from plumbline.demos import metrics, quality
    from plumbline.operators import probes as P
    from plumbline.operators.suites import Suite, run_suite
    from plumbline.plans.variants import derive, run_variants
    from plumbline.sources.tables import read_table

    suite = quality._net_revenue_suite()
    probes = [
        *P.probes_from_contract(quality.BOUNDS_CONTRACT),
        P.PopulationProbe("returns", "flag", None, 0.33),
        P.ImplicationProbe("returns", "l_linestatus", "O", "l_quantity", ">", 10, 0.95, 0.05),
    ]

    def target():
        return metrics.NET_REVENUE.run(metrics.order_lines(spark, SF_DIR))

    def tables():
        from pyspark.sql import functions as F

        return {"customers": read_table(spark, SF_DIR, "customer").withColumn("customer_id", F.col("c_custkey"))}

    def lines():
        return quality._lines(spark, SF_DIR)

    def source():
        return metrics.order_lines(spark, SF_DIR)

    def each_variant():
        specs = [metrics.NET_REVENUE] + [v.spec for v in derive(metrics.NET_REVENUE, source())]
        return [spec.run(source()) for spec in specs]

    return {
        "suite": (
            lambda: [run_suite(target(), Suite(suite.name, [a]), tables()) for a in suite.assertions],
            lambda: run_suite(target(), suite, tables()),
        ),
        "probes": (lambda: [P.run_probes(lines(), [p]) for p in probes], lambda: P.run_probes(lines(), probes)),
        "variants": (each_variant, lambda: run_variants(metrics.NET_REVENUE, source(), store=True)),
    }


def main() -> None:
    from plumbline.demos import QUERIES

    spark = session()
    times = {name: timed(lambda name=name: QUERIES[name](spark, SF_DIR)) for name in HEADLINE}
    pairs = {
        label: {"naive": timed(naive), "fused": timed(fused)} for label, (naive, fused) in naive_pairs(spark).items()
    }
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "pairs": pairs,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
