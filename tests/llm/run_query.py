"""python tests/llm/run_query.py SF_DIR NAME...: the queries next to their SQL in DuckDB, with times."""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


def main():
    from oracle import compare, duck, session

    from plumbline.llm.queries import ORACLES, QUERIES

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = session()
    con = duck(sf_dir)
    for name in names or QUERIES:
        for _ in range(int(os.environ.get("REPEAT", "1"))):
            started = time.time()
            print(name, *compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir), f"{time.time() - started:.1f}s", flush=True)
        QUERIES[name](spark, sf_dir).show(5, truncate=60)


if __name__ == "__main__":
    main()
