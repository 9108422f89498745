"""Compares a registered query with its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


def same(spark, query, sql: str) -> None:
    if not os.path.isdir(SF):
        pytest.skip("the tables are not here")
    got = query(spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=str) == want
