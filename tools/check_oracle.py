"""Run registered queries and their SQL on the same tables and compare the rows.

    python tools/check_oracle.py [--sf DIR] [--conf KEY=VALUE ...] [name or prefix* ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from annolytics.session import local_session  # noqa: E402
from workload import ORACLES, QUERIES  # noqa: E402


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--conf", action="append", default=[])
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session(8, **dict(setting.split("=", 1) for setting in args.conf))
    db = duckdb.connect()
    for path in Path(args.sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    bad = 0
    for name, fn in QUERIES.items():
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        started = time.time()
        try:
            df = fn(spark, args.sf)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - started
            if name not in ORACLES:
                print(f"{'rows':5} {name:26} {len(got):7} {took:6.2f}s", flush=True)
                continue
            result = db.execute(ORACLES[name])
            columns = [c[0] for c in result.description]
            want = rows_of(columns, result.fetchall())
            same = sorted(df.columns) == sorted(columns) and got == want
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {str(error)[:700]}", flush=True)
            continue
        print(f"{'ok' if same else 'DIFF':5} {name:26} {len(got):7} {took:6.2f}s", flush=True)
        if not same:
            bad += 1
            print("   spark:", sorted(df.columns), len(got), "sql:", sorted(columns), len(want))
            only_got = [r for r in got if r not in set(want)][:3]
            only_want = [r for r in want if r not in set(got)][:3]
            print("   only spark:", str(only_got)[:900])
            print("   only sql:  ", str(only_want)[:900])
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
