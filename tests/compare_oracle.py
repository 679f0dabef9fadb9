"""Run registered queries beside their SQL in DuckDB and compare rows.

usage: python tests/compare_oracle.py [name-prefix ...]   (CHECK_SF_DIR picks the tables)
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from marginalia.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "null" if v != v else repr(float(f"{v:.12g}"))
    if v is None:
        return "null"
    return repr(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"{len(rows)} rows, no SQL, {t1 - t0:.1f}s"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    note = f"{len(rows)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {df.columns} vs {cols}"
    a, b = rows_of(df.columns, rows), rows_of(cols, want)
    if a != b:
        sa, sb = set(a), set(b)
        return False, f"{note}; {len(a)} vs {len(b)} rows\n  only spark {sorted(sa - sb)[:3]}\n  only sql   {sorted(sb - sa)[:3]}"
    return True, note


def main(prefixes):
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session("8")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, note = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
    print(f"{bad} failing", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
