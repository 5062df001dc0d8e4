"""Run registered queries against their SQL: ``python tests/oracle_check.py [folder] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if str(s.dtype).startswith("datetime") or (s.dtype == object and s.map(lambda v: hasattr(v, "year")).any()):
            df[c] = pd.to_datetime(s).dt.strftime("%Y-%m-%d %H:%M:%S.%f").fillna("NULL")
        elif pd.api.types.is_numeric_dtype(s) or s.map(lambda v: type(v).__name__ == "Decimal").any():
            df[c] = s.astype(float).map(lambda v: "NULL" if pd.isna(v) else f"{v + 0.0:.9g}")
        else:
            df[c] = s.map(lambda v: "NULL" if v is None or v is pd.NA or (isinstance(v, float) and pd.isna(v)) else str(v))
    return df.sort_values(list(df.columns), ignore_index=True)


def compare(spark_df, sql: str, con: duckdb.DuckDBPyConnection) -> str | None:
    """None when equal, else what differs."""
    got, want = normal(spark_df.toPandas()), normal(con.execute(sql).fetchdf())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} != {list(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    diff = (got != want).any(axis=1)
    if diff.any():
        return f"{int(diff.sum())} of {len(got)} rows differ\n{got[diff].head(3)}\n{want[diff].head(3)}"
    return None


def main() -> int:
    from cohortweave.session import build_local
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = build_local(8), connect(folder)
    sql, queries, bad = entry.oracle_sql(), entry.queries(), 0
    for name in names:
        began = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sql:
                problem = compare(df, sql[name], con)
                note = f"{df.count()} rows" if problem is None else problem
            else:
                rows = df.toPandas()
                problem, note = None, f"rows only: {len(rows)}\n{rows.head(4)}"
        except Exception as e:  # noqa: BLE001
            problem = note = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'OK  ' if problem is None else 'FAIL'} {name} {time.time() - began:.1f}s {note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main())
