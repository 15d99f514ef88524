"""Compares a query's rows with DuckDB's, ignoring order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, d: str) -> tuple[list[str], list[tuple]]:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{d}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    got = c.execute(sql)
    return [x[0] for x in got.description], got.fetchall()


def _key(row: tuple) -> tuple:
    return tuple((x is None, str(x)) for x in row)


def assert_same(df, sql: str, d: str) -> None:
    names, want = duck(sql, d)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=_key)
    want = sorted((tuple(r[names.index(c)] for c in order) for r in want), key=_key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (a, b)
