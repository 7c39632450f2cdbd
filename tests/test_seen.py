"""The seen stream against ``merge_seen`` poll by poll, with restarts and a hot source."""

import random

import pytest
from pyspark.sql import functions as F

from rillflow.operators.incremental import merge_seen
from rillflow.operators.store import Store
from rillflow.streaming.seen import SIGHTINGS, SeenStream


def polls(n=9):
    """Polls of up to 40 ids: most of one source, ids shown again, some long after they left the window."""
    draw, out = random.Random(4), []
    for poll in range(n):
        for source, most in (("hot", 40), ("cold", 6)):
            ids = draw.sample(range(poll * 25, poll * 25 + 60), draw.randint(0, most)) + ([0, 1] if poll == n - 1 else [])
            out += [(source, f"{source}-{i}", poll, pos) for pos, i in enumerate(ids)]
    return out


def test_equals_merge_seen_over_restarts(spark, tmp_path):
    rows = polls()
    window = 50
    schema = SIGHTINGS
    prior = spark.createDataFrame([], "source_key string, external_id string, rank int")
    for poll in range(9):
        page = spark.createDataFrame([r for r in rows if r[2] == poll], schema)
        prior = spark.createDataFrame(merge_seen(prior, page, window).collect(), prior.schema)
    want = sorted(map(tuple, prior.select("source_key", "external_id", "rank").collect()))
    store, landing = Store(spark, str(tmp_path / "store")), str(tmp_path / "landing")
    with pytest.raises(ValueError):
        SeenStream(store, window, ttl_ms=1000).start(None, "unused")
    stream = SeenStream(store, window, buckets=3)
    for part in ((0, 1, 2), (3,), (4, 5, 6, 7, 8)):
        spark.createDataFrame([r for r in rows if r[2] in part], schema).coalesce(1).write.mode("append").parquet(landing)
        stream.start(spark.readStream.schema(schema).parquet(landing), str(tmp_path / "progress")).awaitTermination()
    assert sorted(map(tuple, stream.window_now().collect())) == want
    log = stream.log()
    fresh = log.filter("fresh").groupBy("source_key", "external_id").count()
    assert fresh.count() == len({r[:2] for r in rows})
    once = {r.external_id for r in fresh.filter("count > 1").collect()}
    assert once <= {"hot-0", "hot-1", "cold-0", "cold-1"}  # only what left its bucket's window is new again
    # A batch that is recorded a second time changes nothing.
    before = log.count()
    stream.record(log.select(*[c.split()[0] for c in SIGHTINGS.split(", ")], F.lit(True).alias("fresh")), 0)
    assert stream.log().count() == before
