"""All queries against their SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

from strandline.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return found


def ordered(rows):
    key = lambda row: [(x is None, str(type(x)), round(x, 3) if isinstance(x, float) else x) for x in row]
    return sorted(rows, key=lambda row: str(key(row)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    ours = [tuple(x) for x in frame.select(columns).collect()]
    found = duck.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    theirs = [tuple(x[names.index(c)] for c in columns) for x in found.fetchall()]
    assert len(ours) == len(theirs)
    for a, b in zip(ordered(ours), ordered(theirs), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).collect() is not None
