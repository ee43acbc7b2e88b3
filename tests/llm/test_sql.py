"""Queries of the training-data operators against their SQL twins."""

import check_oracle
import pytest

from loreweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(spark, name):
    assert check_oracle.compare(queries.QUERIES[name](spark, SF), check_oracle.connect(SF), queries.SQL[name]) == ""
