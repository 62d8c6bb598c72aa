"""Runs registered queries and their SQL side by side and compares all values."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value == int(value) else value)
    if isinstance(value, datetime.datetime) and value.tzinfo:
        return value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if hasattr(value, "to_integral_value"):
        return plain(float(value))
    return value


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def oracle_rows(con, sql: str):
    rel = con.sql(sql)
    names = list(rel.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())


def compare(spark, con, name, sf_dir, queries, oracles):
    """Returns (seconds, rows, problem or None)."""
    began = time.time()
    names, rows = spark_rows(queries[name](spark, sf_dir))
    took, n = time.time() - began, sum(rows.values())
    if name not in oracles:
        return took, n, None
    wanted_names, wanted = oracle_rows(con, oracles[name])
    if names != wanted_names:
        return took, n, f"columns {names} != {wanted_names}"
    if rows != wanted:
        extra, missing = rows - wanted, wanted - rows
        return took, n, (f"{sum(rows.values())} rows, want {sum(wanted.values())}; "
                         f"extra {list(extra.items())[:3]} missing {list(missing.items())[:3]}")
    return took, n, None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from arcloom.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    session = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    db = connect(sf)
    chosen = sys.argv[1:] or list(entry.queries())
    for query in chosen:
        try:
            took, n, problem = compare(session, db, query, sf, entry.queries(), entry.oracle_sql())
            mark = "OK  " if problem is None and query in entry.oracle_sql() else "rows" if problem is None else "FAIL"
            print(f"{mark} {query:24s} {took:6.2f}s {n} rows {problem or ''}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"ERR  {query}: {str(e)[:1500]}", flush=True)
