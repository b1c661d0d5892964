"""Run every question on Spark and its SQL on DuckDB over the same tables and compare the rows.

    python tools/oracle_check.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if hasattr(v, "item"):
        v = v.item()
    return v


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(cell(x) for x in row) for row in df[cols].itertuples(index=False, name=None)), key=repr)


def spark_frame(df) -> pd.DataFrame:
    return pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)


def duck_frame(con, sql: str) -> pd.DataFrame:
    cur = con.execute(sql)
    return pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)


def compare(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> str:
    """Empty when equal, else what differs."""
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(duck_df.columns)}"
    a, b = rows_of(spark_df), rows_of(duck_df)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    return f"{len(bad)} of {len(a)} rows, e.g. {bad[0]}" if bad else ""


def main() -> int:
    from rillbook.plans.registry import load_all
    from rillbook.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark, con = local_session(8), connect(sf_dir)
    failed = 0
    for name, question in load_all().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            got = spark_frame(question.run(spark, sf_dir))
            sql = question.oracle()
            took = time.time() - start
            diff = "" if sql is None else compare(got, duck_frame(con, sql))
            status = "rows" if sql is None else ("ok" if not diff else "DIFF")
        except Exception as e:  # noqa: BLE001
            status, diff, took, got = "ERROR", f"{type(e).__name__}: {str(e)[:600]}", time.time() - start, []
        failed += status in ("DIFF", "ERROR")
        print(f"{status:6} {name:34} {len(got):7} rows {took:6.2f}s {diff}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
