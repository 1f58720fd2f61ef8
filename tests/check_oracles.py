"""Run every registered query against its oracle.

    python tests/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, duck  # noqa: E402
from salescope.session import get_spark  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                ok, msg = compare(df, con.execute(sqls[name]).df())
            else:
                n = df.count()
                ok, msg = True, f"{n} rows (no oracle)"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {e}"
            traceback.print_exc()
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:40s} {time.time() - t:6.2f}s {msg[:300]}", flush=True)
    print(f"{bad} failing of {len([n for n in qs if not names or n in names])}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
