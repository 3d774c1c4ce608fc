"""Run registered queries and their SQL side by side: python tools/compare.py FOLDER [name ...]."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from wordmill.plans import catalog  # noqa: E402
from wordmill.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str), ignore_index=True)


def difference(a: pd.DataFrame, b: pd.DataFrame) -> str | None:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} / {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    a, b = normal(a), normal(b)
    kinds = {c: (a[c].dtype, b[c].dtype) for c in a if a[c].dtype.kind != b[c].dtype.kind}
    if kinds:
        return f"types {kinds}"
    for c in a:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same.idxmin()
            return f"column {c}: {str(a.loc[i].to_dict())[:500]} / {str(b.loc[i].to_dict())[:500]} ({(~same).sum()} rows)"
    return None


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    rows = con.execute("SELECT count(*) FROM documents").fetchone()[0]
    print(f"{folder}: {rows} documents", flush=True)
    bad = 0
    for name in names or catalog.QUERIES:
        start = time.time()
        try:
            got = catalog.QUERIES[name](spark, folder).toPandas()
            spent = time.time() - start
            if name not in catalog.SQL:
                print(f"rows  {name}: {len(got)} rows, {spent:.1f}s", flush=True)
                continue
            start = time.time()
            want = con.execute(catalog.SQL[name]).df()
            fault = difference(got, want)
            bad += fault is not None
            print(f"{'ok   ' if fault is None else 'WRONG'} {name}: {len(got)} rows, {spent:.1f}s, sql {time.time() - start:.1f}s {fault or ''}", flush=True)
        except Exception as error:
            bad += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            if len(names) == 1:
                traceback.print_exc()
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
