"""Comparison of a query's rows with those of its SQL in DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    return round(float(value), 6) if isinstance(value, float) else value.item() if hasattr(value, "item") else value


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(plain(v) for v in row)) for row in df.itertuples(index=False))


def assert_same(query_rows: pd.DataFrame, sql: str, sf_dir: str) -> None:
    expected = connection(sf_dir).sql(sql).df()
    assert sorted(query_rows.columns) == sorted(expected.columns)
    ours, theirs = (frame.astype(object).where(frame.notna(), None) for frame in (query_rows, expected))
    kinds = {c: float for c in ours.columns if any(isinstance(v, float) for v in (*ours[c], *theirs[c]))}
    for frame in (ours, theirs):
        for c in kinds:
            frame[c] = [None if v is None else float(v) for v in frame[c]]
    assert rows(ours) == rows(theirs)
