"""Every query against its SQL in another engine, values and types."""

import pytest

from __spark_entry__ import entry
from eventloom.plans.oracle import SQL
from eventloom.plans.queries import QUERIES
from tests.support import SAME_TYPE, TESTDATA, duck, duck_rows, spark_rows

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, SF_DIR)
    names, rows = spark_rows(df)
    other_names, other_rows, types = duck_rows(connection, SQL[name])
    assert names == other_names
    assert len(rows) == len(other_rows) > 0
    assert rows == other_rows
    assert {f.name: SAME_TYPE[f.dataType.simpleString()] for f in df.schema} == types


def test_entry(spark):
    assert entry(spark).count() > 0
