"""Run queries next to their SQL twins and report differences.

usage: python tools/check_twins.py [sf_dir] [name part ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    """One spelling per value for both engines."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(df, con, sql: str) -> str | None:
    """None when rows, column names and values agree, else what differs."""
    rows = df.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    left = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    at = [names.index(c) for c in order]
    right = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    if len(left) != len(right):
        return f"rows {len(left)} against {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, first: {dict(zip(order, bad[0][0]))} against {bad[0][1]}"
    if not left:
        return "no rows"
    return None


def main() -> int:
    from folioguard.plans import ORACLES, QUERIES
    from folioguard.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    con = connect(sf_dir)
    failures = 0
    for name, fn in QUERIES.items():
        if args and not any(part in name for part in args):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in ORACLES:
                trouble = compare(df, con, ORACLES[name])
            else:
                trouble = None if df.count() else "no rows"
        except Exception as exc:  # noqa: BLE001
            trouble = f"{type(exc).__name__}: {str(exc)[:600]}"
        failures += trouble is not None
        label = "ok " if trouble is None else "BAD"
        twin = "" if name in ORACLES else " (no twin)"
        print(f"{label} {name}{twin} {time.time() - start:.1f}s {trouble or ''}", flush=True)
    print("failures", failures)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
