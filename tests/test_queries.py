import pytest

from lumengraph.plans import all_queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_query_gives_the_oracles_rows(spark, duck, same_rows, name):
    found = all_queries.QUERIES[name](spark, SMALL)
    if name in all_queries.ORACLES:
        same_rows(found, duck.sql(all_queries.ORACLES[name]))
    else:
        assert found.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(all_queries.QUERIES) <= set(__spark_entry__.queries())
