"""Run registered queries in Spark and their twins in DuckDB and compare.

usage: python -m tests.oracle [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def compare(spark, con, folder, name, fn, sql):
    df = fn(spark, folder)
    got_cols = df.columns
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return ("rows", len(got), "")
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want_types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return ("COLS", len(got), f"{sorted(set(got_cols) ^ set(want_cols))}")
    bad_types = [f"{n}:{t}/{want_types[n]}" for n, t in df.dtypes if KINDS.get(t) and KINDS[t] != want_types[n]]
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:2]
        only_b = [x for x in b if x not in set(a)][:2]
        return ("DIFF", len(a), f"want {len(b)} rows; spark {only_a} duck {only_b}")
    return ("ok" if not bad_types else "types", len(a), " ".join(bad_types))


def main(argv):
    from panelmill.session import local_session

    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i : i + 2]
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(folder)
    todo = {n: f for n, f in entry.queries().items() if not argv or any(n.startswith(a) for a in argv)}
    twins, bad = entry.oracle_sql(), 0
    for name, fn in todo.items():
        start = time.time()
        try:
            status, n, note = compare(spark, con, folder, name, fn, twins.get(name))
        except Exception as e:  # report and go on
            status, n, note = "ERROR", 0, str(e)[:700]
        bad += status not in ("ok", "rows")
        print(f"{status:6} {name:34} {n:7} rows {time.time() - start:6.1f}s {note}", flush=True)
    print(f"{len(todo)} queries, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
