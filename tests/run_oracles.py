"""CLI: python tests/run_oracles.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_harness import compare, duck  # noqa: E402

from sagerow.session import local_session  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as e

    qs, os_ = e.queries(), e.oracle_sql()
    spark = local_session(partitions=8)
    con = duck(sf_dir)
    ok = bad = 0
    for name in names or sorted(qs):
        if name not in os_:
            t = time.time()
            try:
                n = qs[name](spark, sf_dir).count()
                print(f"ROWS  {name}: {n} rows ({time.time()-t:.1f}s)")
            except Exception as ex:  # noqa: BLE001
                bad += 1
                print(f"ERROR {name}: {ex!r}"[:2000])
            continue
        t = time.time()
        try:
            problems, n = compare(spark, con, name, qs[name], os_[name], sf_dir)
        except Exception as ex:  # noqa: BLE001
            problems, n = [repr(ex)[:1500] + traceback.format_exc()[-1500:]], -1
        if problems:
            bad += 1
            print(f"FAIL  {name}: {problems}"[:3000])
        else:
            ok += 1
            print(f"OK    {name}: {n} rows ({time.time()-t:.1f}s)")
    print(f"{ok} ok, {bad} failing, {len(qs)} queries, {len(os_)} oracles")


if __name__ == "__main__":
    main(sys.argv)
