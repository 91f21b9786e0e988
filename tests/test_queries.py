import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import oracle

from loomspark.plans import code_queries, index_queries, queries  # noqa: F401  the first two add their queries to the last

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    want = oracle.rows_of_sql(con, queries.ORACLE_SQL[name])
    got = oracle.rows_of_spark(queries.QUERIES[name](spark, SF))
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


def test_area_of_a_large_directory_is_whole(spark, tmp_path):
    """A directory of more than 100 entries, which a budget would cut."""
    rows = [(i, f"https://a.example.com/{'en' if i % 3 else 'de'}/{i}?q", "x" * (i % 7)) for i in range(240)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = oracle.rows_of_sql(con, queries.ORACLE_SQL["map_area"])
    assert len(want[1]) > 240
    assert oracle.rows_of_spark(queries.QUERIES["map_area"](spark, str(tmp_path))) == want
