"""Run registered queries against their SQL: ``python tests/check_queries.py SF_DIR [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import importlib

from oracle import compare, connect

import rillflow.catalog as catalog_module
from rillflow import build_session


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "check", f"local[{os.environ.get('BENCH_CPUS', '8')}]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    if names and names[0].startswith("@"):
        queries = importlib.import_module(f"rillflow.catalog.{names[0][1:]}").QUERIES
    else:
        queries = {k: v for k, v in catalog_module.catalog().items() if not names or k in names}
    failed = 0
    for name, (fn, sql) in queries.items():
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            n = None
            problem = compare(df, con, sql) if sql else None
            if not sql:
                n = df.count()
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.2f}s {name}"
              f"{'' if sql else f' (rows {n})'}{': ' + problem[:1500] if problem else ''}", flush=True)
    print("failed:", failed, "of", len(queries))
    return failed


if __name__ == "__main__":
    sys.exit(main())
