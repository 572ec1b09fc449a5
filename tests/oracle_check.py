"""Compare registered queries with their SQL on DuckDB: ``python tests/oracle_check.py [names] [--sf 0.01]``."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(0.0 if v == 0 else v)
    return repr(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql) -> str:
    """Empty when equal, else what differs."""
    got_c, got = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_c, want = table([d[0] for d in cur.description], cur.fetchall())
    if got_c != want_c:
        return f"columns {got_c} != {want_c}"
    if got == want:
        return "" if got else "EMPTY"
    only_g, only_w = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
    return f"rows {len(got)} vs {len(want)}\n   spark {only_g[:3]}\n   sql   {only_w[:3]}"[:1500]


def main() -> None:
    import __spark_entry__ as entry
    from tagloom.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if args.names and not any(name == n or name.startswith(n + "_") for n in args.names):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in sqls:
                diff = compare(df, con, sqls[name])
            else:
                n = df.count()
                diff = "" if n else "EMPTY"
        except Exception as exc:  # noqa: BLE001 - the report goes on
            diff = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += bool(diff)
        print(f"{'ok ' if not diff else 'BAD'} {'O' if name in sqls else 'R'} {time.time() - start:6.1f}s {name} {diff}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
