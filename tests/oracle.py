"""Side-by-side run of a registered query and its SQL in DuckDB.

    python tests/oracle.py [sf_dir] [name or prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return ("null", "")
    if isinstance(value, bool):
        return ("bool", str(value))
    if isinstance(value, float):
        return ("num", "nan" if math.isnan(value) else f"{value + 0.0:.6f}")
    if isinstance(value, int):
        return ("num", f"{value:.6f}" if abs(value) < 2**52 else str(value))
    if isinstance(value, dt.datetime):
        return ("time", value.replace(tzinfo=None).isoformat())
    if isinstance(value, (list, tuple)):
        return ("list", str([_cell(v) for v in value]))
    return (type(value).__name__, str(value))


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """(ok, message) of one query."""
    started = time.time()
    df = query(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for pairing in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if pairing in plan:
            return False, f"the plan pairs all rows of two tables ({pairing})"
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if sql is None:
        return True, f"rows-only {len(got[1])} rows {took:.1f}s"
    cursor = con.execute(sql)
    want = canonical([c[0] for c in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return False, f"rows {len(got[1])} != {len(want[1])}; {got[1][:2]} / {want[1][:2]}"
    for a, b in zip(got[1], want[1], strict=True):
        if a != b:
            return False, f"first difference {a} != {b}"
    return True, f"{len(got[1])} rows {took:.1f}s"


def session():
    from plumbline.session import build_session

    spark = build_session(
        "oracle",
        f"local[{os.environ.get('BENCH_CPUS', '8')}]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    from plumbline.demos import ORACLES, QUERIES

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    wanted = [n for n in QUERIES if not args[1:] or any(n.startswith(p) for p in args[1:])]
    spark, con, failed = session(), duck(sf_dir), []
    for name in wanted:
        try:
            ok, message = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:24s} {message[:900]}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(wanted) - len(failed)}/{len(wanted)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
