"""Command line: python tests/check_oracle.py [sf_dir] [name regex]"""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

from harness import compare, connect, pattern_filter  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from gavelwork.session import get_spark  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("check")
    con = connect(sf)
    oracles = entry.oracle_sql()
    qs = entry.queries()
    failed = 0
    for name in pattern_filter(qs, sys.argv[2] if len(sys.argv) > 2 else ""):
        t = time.time()
        try:
            rows, problem = compare(spark, con, sf, name, qs[name], oracles.get(name))
        except Exception as exc:  # report every failure, keep checking
            rows, problem = -1, f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += problem is not None
        tag = "FAIL" if problem else ("ok" if name in oracles else "ok(rows)")
        print(f"{tag:8} {name} rows={rows} {time.time() - t:.2f}s {str(problem or '')[:1500]}", flush=True)
    print(f"{failed} failed", flush=True)
    spark.stop()
