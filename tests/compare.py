"""Run queries in Spark and their SQL in DuckDB and compare the rows.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{root}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{root}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def diff(spark, con, fn, sql, root):
    """None when equal, otherwise a description."""
    df = fn(spark, root)
    left = rows_of(df.columns, df.collect())
    if sql is None:
        return None if left[1] else "no rows"
    cur = con.execute(sql)
    right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    if left[1] == right[1]:
        return None if left[1] else "equal but empty"
    a, b = set(left[1]), set(right[1])
    only = f"rows {len(left[1])} / {len(right[1])}; spark only {len(a - b)}, sql only {len(b - a)}"
    for x in sorted(a - b)[:2]:
        only += "\n   spark " + str(x)[:300]
    for x in sorted(b - a)[:2]:
        only += "\n   sql   " + str(x)[:300]
    return only


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.session import make_session

    root, names = sys.argv[1], sys.argv[2:]
    spark, con, sqls = make_session(), connect(root), oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            d = diff(spark, con, fn, sqls.get(name), root)
        except Exception as e:  # noqa: BLE001 - report and go on
            d = f"{type(e).__name__}: {str(e)[:1200]}"
        bad += d is not None
        print(f"{'ok  ' if d is None else 'BAD '} {name} {time.time() - t:.2f}s {'' if d is None else d}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
