"""The driver contract."""

import __spark_entry__ as entry_module

from rillflow.catalog import catalog


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[:2] == ["sink_key", "enabled"]
    assert df.count() == 5


def test_every_query_has_sql_and_runs_from_the_entry(spark, sf_dir):
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(catalog()) <= set(sql) <= set(queries)
    assert queries["source_status_counts"](spark, sf_dir).count() > 0
