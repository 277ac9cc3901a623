"""Spark against DuckDB: rows of a query and of its SQL, in an order of their own."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    return x


def rows_of(frame) -> tuple[list[str], list[tuple]]:
    names = sorted(frame.columns)
    rows = [tuple(_plain(v) for v in r) for r in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False, name=None)]
    return names, sorted(rows, key=repr)


def differences(spark_df, con, sql: str) -> list:
    """What differs: column names, counts, or the first few rows."""
    got_names, got = rows_of(spark_df.toPandas())
    want_names, want = rows_of(con.execute(sql).df())
    if got_names != want_names:
        return [got_names, want_names]
    if len(got) != len(want):
        return [len(got), len(want)]
    return [(g, w) for g, w in zip(got, want, strict=True) if g != w and not all(a == b or isinstance(a, float) and isinstance(b, (float, int)) and abs(a - b) < 2e-6 * max(1, abs(a)) for a, b in zip(g, w, strict=True))][:3]
