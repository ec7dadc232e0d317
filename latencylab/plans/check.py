"""Run registered queries against their DuckDB oracle: ``python -m latencylab.plans.check [sf_dir] [names]``."""

from __future__ import annotations

import sys
import time


def main(sf_dir: str = "/root/testdata/sf0.01", names: str = "") -> int:
    from latencylab.plans.catalog import queries
    from latencylab.plans.compare import compare, duck_connection
    from latencylab.plans.oracle import oracle_sql
    from latencylab.session import local_session

    spark = local_session(8)
    con = duck_connection(sf_dir)
    qs, sqls = queries(), oracle_sql()
    wanted = names.split(",") if names else sorted(qs)
    bad = 0
    for name in wanted:
        t0 = time.time()
        if name not in sqls:
            n = qs[name](spark, sf_dir).count()
            print(f"{name:28s} rows-only {n} ({time.time() - t0:.1f}s)", flush=True)
            continue
        try:
            r = compare(qs[name](spark, sf_dir), sqls[name], con)
        except Exception as e:  # report and continue
            bad += 1
            print(f"{name:28s} ERROR {type(e).__name__}: {str(e)[:600]}", flush=True)
            continue
        status = "OK " if r["ok"] else "BAD"
        bad += 0 if r["ok"] else 1
        extra = {k: v for k, v in r.items() if k not in ("ok",)} if not r["ok"] else {
            "rows": r["spark_rows"], "exact": r["exact"]}
        print(f"{name:28s} {status} ({time.time() - t0:.1f}s) {extra}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
