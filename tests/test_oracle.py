"""Registered queries against their SQL in DuckDB, on the small test tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from trialstream.plans.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, list):
        return tuple(map(plain, value))
    number = float(value)
    return None if math.isnan(number) else round(number, 4) + 0.0


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert df.columns
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    want = rows(names, result.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if any(not (a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) < 2e-4) for a, b in zip(g, w, strict=True))]
    assert not bad, [(sorted(names)[i], x, y) for g, w in bad[:3] for i, (x, y) in enumerate(zip(g, w, strict=True)) if x != y]
