import pandas as pd
import pytest

from tidemill.llm import queries
from tools.compare import normal


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    want = duck.execute(queries.SQL[name]).df()
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False)


def test_columns(spark, small):
    assert queries.QUERIES["p7_ids"](spark, small).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert queries.QUERIES["p9_found"](spark, small).columns == ["doc_id"]
    assert queries.QUERIES["p8_containers"](spark, small).columns == ["doc_id", "piece", "begin", "end", "container"]
