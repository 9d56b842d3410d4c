"""Every registered query runs and, where it has an oracle, gives the same rows as DuckDB on the same files."""

import math
import os

import duckdb
import pytest

from quarry.plans import catalog


def same(rows, columns):
    """Rows as sorted lists in column order, floats rounded a little beyond the queries' own rounding."""
    plain = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else repr(round(float(v), 5)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted([plain(r[c]) for c in columns] for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    out = duckdb.connect()
    for f in os.listdir(sf):
        out.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return out


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    frame = catalog.QUERIES[name](spark, sf)
    rows = [r.asDict() for r in frame.collect()]
    if name not in catalog.ORACLES:
        return
    found = duck.execute(catalog.ORACLES[name])
    columns = sorted(c[0] for c in found.description)
    assert columns == sorted(frame.columns)
    names = [c[0] for c in found.description]
    assert same(rows, columns) == same([dict(zip(names, r)) for r in found.fetchall()], columns)
