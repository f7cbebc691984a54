"""DuckDB on the test tables, and a form of results that can be compared."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

DATA = Path("/root/testdata/sf0.001")


def run_sql(sql: str, folder: Path = DATA) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con.execute(sql).df()


def _cell(x: object) -> str:
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "NULL"
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    return str(x.tolist() if hasattr(x, "tolist") else x)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    names = sorted(df.columns)
    return sorted(tuple(_cell(x) for x in row) for row in df[names].itertuples(index=False, name=None))
