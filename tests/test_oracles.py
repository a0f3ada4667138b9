"""Each registered query of the library beside its SQL on DuckDB, over whole tables."""

import os

import duckdb
import pytest

import lanework.plans.meets
import lanework.plans.relational
import lanework.plans.texts
import lanework.streaming.queries  # noqa: F401
from lanework.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS FROM '{sf_dir}/{name}'")
    return con


def plain(v):
    if isinstance(v, float) and v == int(v):
        return int(v)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    if name not in ORACLES:
        assert rows
        return
    said = db.execute(ORACLES[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in said.fetchall()), key=repr)
    assert rows == want
