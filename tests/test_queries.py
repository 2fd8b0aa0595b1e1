"""Queries against their SQL counterparts on the smallest tables."""

import math

import duckdb
import pytest

from stratum.plans import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "supplier")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    norm = lambda x: "" if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(str(norm(v)) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(oracles.ORACLES[name])
    assert columns == sorted(want.columns)
    assert plain(got.select(*columns).collect()) == plain(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_every_oracle_has_a_query():
    assert set(oracles.ORACLES) <= set(queries.QUERIES)


def test_every_query_has_an_oracle():
    assert set(queries.QUERIES) == set(oracles.ORACLES)
