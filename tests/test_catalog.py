from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.oracle_check import differences, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle(SF)


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    assert differences(spark, duck, name, SF) == []


def test_entry_and_coverage(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.queries()["pack_context"](spark, SF).count() == 50
