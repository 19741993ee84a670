import pytest

from quern.llm import queries

from ..compare import DATA, same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_are_those_of_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_a_row_for_each_row_of_the_table(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    table = "pages" if "page_id" in got.columns else "embeddings" if "vec_id" in got.columns else "documents"
    assert got.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()
