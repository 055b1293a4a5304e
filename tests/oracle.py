"""Compare registered queries with their SQL restatement run by DuckDB.

Command line: ``python tests/oracle.py [name-part ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


SPARK_SECONDS: dict[str, float] = {}


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{directory}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def order_key(row):
    return tuple((v is None, type(v).__name__ if not isinstance(v, (int, float)) else "n",
                  round(v, 6) if isinstance(v, float) and math.isfinite(v) else str(v)
                  if isinstance(v, (tuple, bytes, bytearray)) else v)
                 if v is not None else (True, "", 0) for v in row)


def sorted_rows(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=order_key)


def close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def compare(spark, con, directory, name, fn, sql) -> str:
    """'' when equal, otherwise what differs."""
    start = time.time()
    frame = fn(spark, directory)
    names = frame.columns
    rows = [tuple(r) for r in frame.collect()]
    SPARK_SECONDS[name] = time.time() - start
    if sql is None:
        return "" if rows else "no rows"
    result = con.execute(sql)
    sql_names = [d[0] for d in result.description]
    sql_rows = result.fetchall()
    if sorted(names) != sorted(sql_names):
        return f"columns {sorted(names)} != {sorted(sql_names)}"
    left, right = sorted_rows(names, rows), sorted_rows(sql_names, sql_rows)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    if not left:
        return "no rows on either side"
    kinds = {c: (type(a).__name__, type(b).__name__) for c, a, b in zip(sorted(names), left[0], right[0])}
    mixed = {c: k for c, k in kinds.items() if k[0] != k[1] and "NoneType" not in k}
    if mixed:
        return f"types {mixed}"
    for a, b in zip(left, right):
        if a != b and not all(close(x, y) for x, y in zip(a, b)):
            return f"values {sorted(names)} {a} != {b}"
    if left != right:
        return "NEAR: equal only within tolerance"
    return ""


def main() -> int:
    import __spark_entry__ as entry
    from quern.session import local_session

    directory = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = local_session(8)
    con = connect(directory)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    total = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        total += 1
        start = time.time()
        try:
            note = compare(spark, con, directory, name, fn, oracles.get(name))
        except Exception as exc:  # report and go on
            note = f"ERROR {type(exc).__name__}: {str(exc)[:700]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += bool(note)
        took, mine = time.time() - start, SPARK_SECONDS.get(name, -1.0)
        if note or mine > 4 or took > 8:
            print(f"{'FAIL' if note else 'slow'} {name} {mine:.1f}s of {took:.1f}s {note}", flush=True)
    print(f"{total - bad} of {total} fine")
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main() else 0)
