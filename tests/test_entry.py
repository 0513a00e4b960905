"""Driver contract: entry() and every registered query of the library run on sf0.001."""

import __spark_entry__ as E
from paths import SF001
from ferret.plans import registry


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0


def test_every_query_gives_rows_and_named_columns(spark):
    sql = E.oracle_sql()
    assert set(registry.QUERIES) <= set(E.queries()) and set(sql) <= set(E.queries())
    for name, q in registry.QUERIES.items():
        df = q(spark, SF001)
        assert df.count() > 0, name
        assert all(c and not c.startswith("_") for c in df.columns), name
        if name in sql:
            assert "SELECT" in sql[name].upper()
