"""Runs every query beside its SQL in DuckDB: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(r[i] for i in order) for r in rows], key=repr)


def same(spark, con, name, query, sql, sf_dir) -> str:
    """'' or what differs."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if mine else "no rows"
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    theirs = rows_of(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} {sorted(names)}"
    if mine != theirs:
        a, b = [x for x in mine if x not in set(theirs)][:2], [x for x in theirs if x not in set(mine)][:2]
        return f"{len(mine)} and {len(theirs)} rows; {str(a)[:300]} | {str(b)[:300]}"
    return ""


def main() -> None:
    import __spark_entry__ as e
    from lexmill.session import get_spark

    spark = get_spark(master="local[6]")
    spark.sparkContext.setLogLevel("ERROR")
    con, q, o = connect(sys.argv[1]), e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or [n for n in q if not n.startswith("op") and n != "pipeline"]:
        t = time.time()
        try:
            why = same(spark, con, name, q[name], o.get(name), sys.argv[1])
        except Exception as x:
            why = f"{type(x).__name__}: {str(x)[:500]}"
        print(f"{'ok  ' if not why else 'BAD '} {name} {time.time() - t:.1f}s {'' if name in o else '(rows only)'} {why}", flush=True)


if __name__ == "__main__":
    main()
