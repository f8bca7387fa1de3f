"""Every registered query of the library: runs, has a stable schema, equals its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from marginalia import catalog
from marginalia.session import TABLES

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="session")
def db(sf):
    sf = os.environ.get("MARGINALIA_TEST_SF", sf)
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(plain(x) for x in value.values())
    if isinstance(value, float) or type(value).__name__ in ("float64", "float32", "Decimal"):
        return f"{float(value):.9g}"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if hasattr(value, "item"):
        return value.item()
    return value.replace(tzinfo=None).isoformat() if hasattr(value, "isoformat") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    sf = os.environ.get("MARGINALIA_TEST_SF", sf)
    got = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in got.collect()]
    assert rows or name in ("standard_ids",)
    if name in SQL:
        want = db.execute(SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        mine, theirs = rows_of(got.columns, rows), rows_of(columns, want.fetchall())
        assert len(mine) == len(theirs)
        different = [(a, b) for a, b in zip(mine, theirs) if a != b]
        assert not different, different[:2]
