"""Run queries beside their DuckDB SQL: ``python tests/compare.py DIR [NAME...]``; also used by the tests."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter
from datetime import date, datetime

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connection(directory: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{directory}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value) if not isinstance(value, (int, str, bool, type(None))) else value


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, query, sql: str, directory: str) -> tuple[bool, str]:
    df = query(spark, directory)
    ours = bag(df.columns, df.collect())
    res = connection(directory).execute(sql)
    columns = [c[0] for c in res.description]
    theirs = bag(columns, res.fetchall())
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} and {sorted(columns)}"
    if ours == theirs:
        return True, f"{sum(ours.values())} rows"
    return False, f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:3]}, only SQL {list((theirs - ours).items())[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from arbora.runtime import session

    spark = session()
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            if name in oracles:
                ok, said = compare(spark, queries[name], oracles[name], sys.argv[1])
            else:
                ok, said = True, f"{queries[name](spark, sys.argv[1]).count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            ok, said = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - began:.1f}s {said}", flush=True)
