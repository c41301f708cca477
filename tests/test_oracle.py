"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from estate_queries import MODULES
from tools.check import TYPES, compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(name for module in MODULES for name in module.QUERIES)
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_a_twin():
    assert set(NAMES) <= set(QUERIES)
    assert set(NAMES) <= set(ORACLE)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    ok, note = compare(df, con, ORACLE[name])
    assert ok, note
    assert "TYPES" not in note, note
    assert all(t in TYPES for _, t in df.dtypes)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
