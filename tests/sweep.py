"""Run every query against its oracle: python tests/sweep.py [sf] [name-part ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import differences, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from stallwise.session import get_spark  # noqa: E402


def main() -> None:
    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    want = sys.argv[2:]
    spark = get_spark("sweep", 8)
    con = duck(sf)
    bad = 0
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if want and not any(w in name for w in want):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            msg = differences(df, con, oracles[name]) if name in oracles else (None if df.count() else "EMPTY (no oracle)")
        except Exception as e:  # noqa: BLE001 - a sweep reports and goes on
            msg = f"{type(e).__name__}: {str(e)[:1200]}"
        took = time.time() - t
        if msg:
            bad += 1
            print(f"BAD {name} {took:.1f}s {msg}")
        elif took > 6 or want:
            print(f"ok  {name} {took:.1f}s")
    print("bad", bad)


if __name__ == "__main__":
    main()
