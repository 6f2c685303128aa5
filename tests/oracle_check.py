"""Compare every registered query with its SQL on the same Parquet tables.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr)


FAMILIES = {"int": "int", "bigint": "int", "smallint": "int", "tinyint": "int", "integer": "int", "hugeint": "HUGE",
            "double": "double", "string": "string", "varchar": "string", "timestamp_ntz": "timestamp",
            "timestamp": "timestamp", "date": "date", "boolean": "boolean"}


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), "rows-only"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]).lower() for d in cur.description}
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return len(got), f"COLUMNS {sorted(df.columns)} vs {sorted(cols)}"
    for column, kind in df.dtypes:
        a, b = FAMILIES.get(kind, kind), FAMILIES.get(types[column], types[column])
        if a != b:
            return len(got), f"TYPE {column}: {kind} vs {types[column]}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        lack = [r for r in want if r not in set(got)][:3]
        return len(got), f"DIFF rows {len(got)} vs {len(want)}\n   cols {sorted(cols)}\n   extra {extra}\n   lack {lack}"
    return len(got), "ok"


def main(sf_dir, names):
    import __spark_entry__ as entry
    from matchday.session import build_session

    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                               "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        started = time.time()
        try:
            n, verdict = compare(spark, con, name, queries[name], sqls.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            n, verdict = -1, "ERROR " + (traceback.format_exc() if names else str(error)[:600])
        bad += verdict not in ("ok", "rows-only")
        print(f"{name:32s} {n:7d} rows {time.time() - started:6.2f}s {verdict}", flush=True)
    print(f"{bad} failing of {len(names or queries)}; {len(sqls)} with SQL")
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    sys.exit(min(main(folder, args), 1))
