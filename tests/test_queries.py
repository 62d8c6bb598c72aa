"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import oracle
from arcloom import plans

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, db, name):
    took, rows, problem = oracle.compare(spark, db, name, SF, entry.queries(), entry.oracle_sql())
    assert problem is None
    assert rows > 0


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLES)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 1
    assert out.columns == ["unique_records", "unique_bytes", "revisit_records", "revisit_bytes",
                           "ratio_records", "ratio_bytes"]
