"""Rows of a Spark result and of its SQL twin in DuckDB, in comparable form."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].copy()
    for c in df:
        kind = str(df[c].dtype)
        if kind.startswith("datetime"):
            df[c] = df[c].dt.strftime("%Y-%m-%d")
        elif kind.startswith(("int", "float", "Int")):
            df[c] = df[c].astype(float) + 0.0
        elif kind == "object":
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT else str(v))
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


def duck(sql: str, sf: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(sql).df()
