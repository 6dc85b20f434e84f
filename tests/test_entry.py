import __spark_entry__ as e


def test_oracles_belong_to_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    assert e.entry(spark).count() == 6
