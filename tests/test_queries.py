"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

from compare import connect, rows
from fieldtally.plans import more  # noqa: F401
from fieldtally.plans import rows as registered  # noqa: F401
from fieldtally.plans import streams  # noqa: F401
from fieldtally.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    got = QUERIES[name](spark, data).toPandas()
    want = connect(data).execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, data, name):
    # The smallest table has no dense settlement.
    assert QUERIES[name](spark, data).count() > 0 or name == "p8_settlement_clusters"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
