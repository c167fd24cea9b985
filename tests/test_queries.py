"""Every registered query runs on the small tables; those with SQL equal what DuckDB computes."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

LLM = {n for n in entry_module.queries() if n.startswith(("p7_", "p8_", "p9_"))}
NAMES = sorted(set(entry_module.queries()) - LLM)


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def close(x, y) -> bool:
    if isinstance(x, float) or isinstance(y, float):
        return isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-9)
    return x == y


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, duck, name):
    df = entry_module.queries()[name](spark, data)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)
    assert len(rows) == len(expected)
    assert all(all(map(close, a, b)) for a, b in zip(rows, expected))


def test_entry(spark, data):
    assert entry_module.entry(spark).limit(1).count() == 1
