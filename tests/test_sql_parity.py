"""Every query that has SQL gives what the SQL gives, on the smallest tables."""

import pandas as pd
import pytest

from tidemill.plans import reference, training
from tools.compare import normal

QUERIES, SQL = training.QUERIES | reference.QUERIES, training.SQL | reference.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, small, name):
    got = QUERIES[name](spark, small).toPandas()
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False, rtol=1e-12, atol=1e-9)
