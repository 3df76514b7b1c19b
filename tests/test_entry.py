import __spark_entry__ as entry


def test_registered_names_are_consistent():
    names, sql = entry.queries(), entry.oracle_sql()
    assert len(names) > 100 and set(sql) <= set(names)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
