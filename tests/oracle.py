"""Run registered queries against DuckDB on the same files and compare them."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}f" if v else "0f"
    return f"{type(v).__name__}:{v}" if not isinstance(v, str) else v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str, sf_dir: str):
    df = fn(spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = normal(rel.columns, rel.fetchall())
    return got, want


def explain_difference(got, want) -> str:
    if got[0] != want[0]:
        return f"columns differ: {sorted(set(got[0]) ^ set(want[0]))}"
    a, b = set(got[1]), set(want[1])
    lines = [f"rows {len(got[1])} vs {len(want[1])}; only here {len(a - b)}, only oracle {len(b - a)}"]
    for x, y in list(zip(sorted(a - b), sorted(b - a)))[:3]:
        lines.append("  " + ", ".join(f"{c}: {p} | {q}" for c, p, q in zip(got[0], x, y) if p != q))
        lines.append("    of " + str(x)[:200])
    return "\n".join(lines)


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from squadlake.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or list(queries):
        start = time.time()
        try:
            if name not in oracles:
                print(f"{name}: rows only, {queries[name](spark, sf_dir).count()} rows, {time.time() - start:.1f}s", flush=True)
                continue
            got, want = compare(spark, con, queries[name], oracles[name], sf_dir)
            same = got == want
            bad += not same
            print(f"{name}: {'ok' if same else 'DIFFERS'} {len(got[1])} rows {time.time() - start:.1f}s", flush=True)
            if not same:
                print(explain_difference(got, want), flush=True)
        except Exception as e:  # keep checking the others
            bad += 1
            print(f"{name}: ERROR {type(e).__name__} {str(e)[:1500]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
