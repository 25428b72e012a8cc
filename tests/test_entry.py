import __spark_entry__ as entry


def test_registry_is_consistent():
    q, sql = entry.queries(), entry.oracle_sql()
    assert len(q) > 180 and set(sql) <= set(q)


def test_flagship_runs(spark):
    out = entry.entry(spark)
    assert out.columns == ["signal", "horizon", "mean_ic", "std_ic", "positive_share", "n_dates"] and out.count() == 1
