"""The digest's second order of the rows is dealt by a key with many values."""

from rillflow.catalog import checking, views
from rillflow.operators import store


def test_no_task_gets_all_rows(spark, sf_dir, monkeypatch):
    dealt = []
    monkeypatch.setattr(checking.st, "table_digest", lambda df: dealt.append(df) or store_digest(df))
    checking.digest(spark, sf_dir)
    rows = views.doc_signals(spark, sf_dir).count()
    # Before adaptive execution joins what is small, the rows stand in many partitions.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        most = max(len(p) for p in dealt[1].select("id").rdd.glom().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert most < rows


store_digest = store.table_digest
