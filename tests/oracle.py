"""Runs a query and its DuckDB SQL over the same tables and compares all rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


def differences(spark, sf_dir, query, sql, con) -> str | None:
    got = query(spark, sf_dir)
    want = con.execute(sql)
    a, b = rows(got.columns, got.collect()), rows([d[0] for d in want.description], want.fetchall())
    if a == b:
        return None
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    x, y = [r for r in a[1] if r not in set(b[1])][:3], [r for r in b[1] if r not in set(a[1])][:3]
    return f"{len(a[1])} and {len(b[1])} rows; only here {x}; only in SQL {y}"
