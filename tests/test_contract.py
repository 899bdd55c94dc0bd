"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from check import compare, duck
from contract.oracles import ORACLES
from contract.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["doc_id", "pii_detected", "n_findings", "method", "score"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name) is None
