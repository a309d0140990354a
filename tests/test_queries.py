"""Every registered query against its SQL on the smallest driver tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from latticeloom.plans import load_queries  # noqa: E402
from tools.check_queries import TABLES, compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
REGISTRY = load_queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(REGISTRY.QUERIES))
def test_query(spark, con, name):
    got = REGISTRY.QUERIES[name](spark, FOLDER).toPandas()
    if name in REGISTRY.ORACLES:
        assert compare(got, con.execute(REGISTRY.ORACLES[name]).df()) == ""
    else:
        assert len(got) > 0


def test_every_check_has_a_query():
    assert set(REGISTRY.ORACLES) <= set(REGISTRY.QUERIES)
