"""Runs registered queries beside their SQL in DuckDB and compares them as the driver does: by columns in
name order and rows in any order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(rows, order):
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> str:
    """Empty if equal."""
    con.execute(sql)
    names = [x[0] for x in con.description]
    want = con.fetchall()
    got = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a = plain(got, sorted(range(len(df.columns)), key=lambda i: df.columns[i]))
    b = plain(want, sorted(range(len(names)), key=lambda i: names[i]))
    if a != b:
        bad = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
        return f"{len(a)} and {len(b)} rows, {len(bad)} differ, such as {bad[:3]}"
    return ""
