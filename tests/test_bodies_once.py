"""What reads the bodies of a batch, and how the pages of the drain are ranked."""

import json

from pyspark.sql import functions as F

from rillflow.catalog import flowing
from rillflow.operators.store import Store
from rillflow.schemas import RAW_PAYLOADS
from rillflow.sources.registry import default_sources
from rillflow.streaming import Ingest


def test_what_follows_staging_needs_no_payloads(spark, tmp_path):
    body = json.dumps({"version": "https://jsonfeed.org/version/1.1", "items": [{"id": "i", "content_text": "t"}]})
    rows = [(1, 0, "jsonfeed", "jsonfeed", "a", "u", 200, {"ETag": "e"}, body, None, 1)]
    frame = spark.createDataFrame(rows, RAW_PAYLOADS).withColumn("fetched_at", F.timestamp_seconds(F.lit(1_704_067_200)))
    store = Store(spark, str(tmp_path / "s"))
    ingest = Ingest(store, default_sources(), ["archive"])
    ingest._stage(frame, 0)
    ingest._derive(None, 0)
    store.commit("ingest", 0)
    assert store.current("signals", ["seq"]).count() == 1 and store.current("deliveries").count() == 1


def test_no_language_is_ranked_in_one_window(spark, sf_dir):
    plan = flowing._drained(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    ranks = [line for line in plan.splitlines() if "row_number() windowspecdefinition(lang#" in line and "doc_id#" in line]
    assert ranks and all("slice#" in line for line in ranks)
