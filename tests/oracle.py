"""Compares a query with its SQL on the small test tables, columns by name, rows in any order."""

from __future__ import annotations

import datetime
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def agree(spark, query, sql, sf: str = SF) -> int:
    duckdb = pytest.importorskip("duckdb")
    if not Path(sf).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = query(spark, sf)
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(_plain(r[names.index(c)]) for c in sorted(names)) for r in done.fetchall()), key=str)
    have = sorted((tuple(_plain(r[c]) for c in sorted(names)) for r in df.collect()), key=str)
    assert have == want
    return len(have)
