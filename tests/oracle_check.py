"""Runs registered queries next to their check SQL and compares rows exactly.

    python tests/oracle_check.py --sf 0.01 [--section q_rules] [names...]
"""

from __future__ import annotations

import argparse
import glob
import importlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows, names, order):
    index = [names.index(n) for n in order]
    def cell(v):
        if isinstance(v, bool) or v is None:
            return repr(v)
        if isinstance(v, float):
            return "0.0" if v == 0 else repr(v)
        return str(v)
    return sorted(tuple(cell(r[i]) for i in index) for r in rows)


def compare(spark_df, con, check: str):
    """(ok, message)"""
    order = sorted(spark_df.columns)
    got = plain([tuple(r) for r in spark_df.collect()], spark_df.columns, order)
    cur = con.execute(check)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    if sorted(names) != order:
        return False, f"columns {order} against {sorted(names)}"
    want = plain(cur.fetchall(), names, order)
    simple = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "timestamp": "TIMESTAMP"}
    odd = [f"{n}:{t}/{kinds[n]}" for n, t in spark_df.dtypes if simple.get(t, t) != kinds[n] and not kinds[n].startswith("TIMESTAMP")]
    note = f" types {odd}" if odd else ""
    if got == want:
        return (not odd and bool(got)), f"{len(got)} rows{note}" + ("" if got else " EMPTY")
    extra = [r for r in got if r not in set(want)][:2]
    lost = [r for r in want if r not in set(got)][:2]
    return False, f"{len(got)} against {len(want)} rows; spark only {extra}; check only {lost}{note} {order}"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--section")
    args = ap.parse_args()
    from sitefit.session import local_session

    spark = local_session()
    if args.section:
        importlib.import_module(f"sitefit.catalog.{args.section}")
        from sitefit.catalog.registry import ORACLES, QUERIES
    else:
        from sitefit.catalog import load
        QUERIES, ORACLES = load()
    folder = f"/root/testdata/sf{args.sf}"
    con, bad = connect(folder), 0
    from sitefit.catalog.registry import SECTION_OF
    chosen = args.names or [n for n in QUERIES if not args.section or SECTION_OF[n] == args.section]
    for name in chosen:
        a = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                ok, text = compare(df, con, ORACLES[name])
            else:
                n = len(df.collect())
                ok, text = n > 0, f"{n} rows, no check"
        except Exception as error:  # noqa: BLE001
            ok, text = False, f"{type(error).__name__}: {str(error)[:900]}"
        bad += not ok
        print(("ok   " if ok else "FAIL "), name, text, f"{time.time() - a:.1f}s", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(min(main(), 1))
