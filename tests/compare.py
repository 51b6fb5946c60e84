"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import pathlib

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if pathlib.Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if names, row counts and all values agree, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=_key)
    got = sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=_key)
    if len(want) != len(got):
        return f"{len(got)} rows and {len(want)} rows"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ in {sorted(names)}; first: {bad[0]}"
    return None
