import __spark_entry__ as E

MAY_BE_EMPTY: set[str] = set()  # on the smallest tables


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and {r.split for r in df.select("split").distinct().collect()} == {"train", "test"}
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    own = {k for k in qs if k != "pipeline" and not k.startswith("op")}
    assert own - set(sql) <= {"edit_distance"}
    assert len(qs) >= 62


def test_every_query_runs_on_smoke_data(spark):
    empty = [name for name, fn in E.queries().items() if fn(spark, "/root/testdata/sf0.001").count() == 0]
    assert set(empty) <= MAY_BE_EMPTY, empty
