import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
import oracle

from loomspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    want = oracle.rows_of_sql(oracle.connect(SF), queries.ORACLE_SQL[name])
    assert oracle.rows_of_spark(queries.QUERIES[name](spark, SF)) == want
