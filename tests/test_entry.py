import __spark_entry__


def test_contract():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert queries and set(sql) <= set(queries)
    assert all(callable(f) for f in queries.values()) and all(isinstance(x, str) for x in sql.values())
