"""Every registered query against its SQL on the smallest tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from shelfmine.plans import registry
from tools.check import comparable, connect

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    cursor = duck.execute(entry.oracle_sql()[name])
    want = pd.DataFrame(cursor.fetchall(), columns=[d[0] for d in cursor.description])
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got).values.tolist() == comparable(want).values.tolist()


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
