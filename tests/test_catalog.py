"""Every registered query with SQL must agree with it on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CHECKS = entry.oracle_sql()
SLOW = ("x", "m1_", "m2_", "m3_", "m10", "s12")


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if v is None or isinstance(v, (bool, int)):
        return v
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in CHECKS if os.environ.get("ALL_QUERIES") or not n.startswith(SLOW)])
def test_query_matches_sql(spark, db, name):
    got = entry.queries()[name](spark, FOLDER)
    cur = db.execute(CHECKS[name])
    names = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    left = sorted((tuple(_plain(r[c]) for c in order) for r in got.collect()), key=repr)
    right = sorted((tuple(_plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert left == right


def test_entry(spark):
    assert entry.entry(spark).count() > 0
