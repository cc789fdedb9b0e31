"""Queries of the subpackage against their SQL twins."""

import oracle
import pytest
from framelens.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf, name):
    assert oracle.compare(catalog.QUERIES[name](spark, sf), oracle.connect(sf), catalog.ORACLES[name]) == []


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
