"""The delivery stream: retries at timers, restarts, resets, and the same rows as the fold of its logs."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from rillflow.operators import delivery, sinks
from rillflow.operators.store import Store
from rillflow.schemas import DELIVERIES, RAW_PAYLOADS
from rillflow.sources.registry import default_sources
from rillflow.streaming import Courier, Ingest, Policy, Target
from rillflow.streaming.courier import MOVES, answer_of, publish, wait_seconds

POLICY = Policy(max_attempts=3, base=0.3, cap=0.5)


def receiver():
    """A function of no module, as workers don't know that of the tests."""

    def flaky(url, headers, body):
        """An answer by the request and the attempt alone."""
        draw = zlib.crc32(f"{headers['Idempotency-Key']}:{headers['X-Attempt']}".encode()) % 6
        if draw == 0:
            raise OSError("reset by peer")
        return ((200, None, None), (500, None, None), (429, "0", None), (503, "0.2", None), (410, None, None))[draw - 1]

    return flaky


def feed(items):
    return json.dumps({"version": "https://jsonfeed.org/version/1.1", "title": "T", "items": items})


def ingested(spark, store, batch, items):
    row = (batch, 0, "jsonfeed", "jsonfeed", "a", "https://x/feed", 200, {}, feed(items), None, 1)
    at = F.timestamp_seconds(F.lit(1_704_067_200 + batch * 60))
    Ingest(store, default_sources(), ["archive", "mirror", "nowhere"]).process(spark.createDataFrame([row], RAW_PAYLOADS).withColumn("fetched_at", at), batch)


def item(i, text):
    return {"id": f"i{i}", "content_text": text, "url": f"https://x/{i}", "date_published": "2024-01-01T00:00:00Z"}


@pytest.fixture(scope="module")
def ended(spark, tmp_path_factory):
    """A store after two ingested batches, delivered by a stream that was stopped in between."""
    root = str(tmp_path_factory.mktemp("courier"))
    store = Store(spark, f"{root}/store")
    courier = Courier(store, {"archive": Target("https://a", receiver()), "mirror": Target("https://m", receiver())}, POLICY)
    ingested(spark, store, 0, [item(i, f"text {i}") for i in range(20)])
    first = publish(store, f"{root}/queue")
    assert courier.run_until_settled(f"{root}/queue", f"{root}/progress", every="200 milliseconds")
    ingested(spark, store, 1, [item(i, f"text {i} again") for i in range(0, 20, 3)])
    second = publish(store, f"{root}/queue")
    assert first == [1] and len(second) > 1 and publish(store, f"{root}/queue") == []
    # What a crash wrote twice: the first version's rows in another file.
    spark.read.parquet(f"{root}/queue/version=1").coalesce(1).write.mode("append").parquet(f"{root}/queue/version={max(second)}")
    assert courier.run_until_settled(f"{root}/queue", f"{root}/progress", every="200 milliseconds")
    return store, root


def test_rows_are_the_fold_of_the_logs(spark, ended):
    store, root = ended
    queue = spark.read.parquet(f"{root}/queue/version=*").select("sink_key", "event_id", "event_hash", "seq", "at").distinct()
    moves = spark.read.schema(MOVES).parquet(f"{root}/store/moves")
    queued = queue.filter("sink_key != 'nowhere'").withColumn("seq", F.col("seq") * 1000)
    attempts = moves.filter("outcome IS NOT NULL").withColumn("seq", F.col("seq") * 1000 + F.col("attempts"))
    want = delivery.fold_deliveries(queued, attempts, *POLICY)
    names = DELIVERIES.fieldNames()
    got = store.current("deliveries").filter("sink_key != 'nowhere'")
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(map(tuple, want.select(*names).collect()), key=str)
    assert {r.status for r in got.collect()} == {"delivered", "dead"} and got.count() == 40
    assert {r.status for r in store.current("deliveries").filter("sink_key = 'nowhere'").collect()} == {"pending"}


def test_each_attempt_waits_and_no_row_of_the_queue_is_sent_twice(spark, ended):
    store, root = ended
    rows = spark.read.schema(MOVES).parquet(f"{root}/store/moves").filter("outcome IS NOT NULL").collect()
    tries = [(r.sink_key, r.event_id, r.seq, r.attempts) for r in rows]
    assert len(tries) == len(set(tries)) and any(r.attempts == 3 for r in rows)
    by = {t: r for t, r in zip(tries, rows)}
    for (sink, event, seq, attempt), r in by.items():
        if attempt > 1:
            before = by[sink, event, seq, attempt - 1]
            assert before.status == "failed" and r.attempted_at >= before.next_attempt_at
    changed = {r.event_id for r in rows if r.seq > 1}
    assert len(changed) == 7


def test_scalar_rules_agree_with_the_columns(spark):
    answers = [(s, w, f) for s in (None, 200, 204, 301, 400, 408, 425, 429, 500, 502, 503, 504) for w in (None, "7", "-3", "soon") for f in (None, "down") if s or f]
    table = spark.createDataFrame([("e", "h", *a) for a in answers], "event_id string, sent_hash string, status int, retry_after_text string, failure string")
    want = [(r.outcome, r.retry_after, r.error) for r in sinks.classify_responses(table).collect()]
    assert [tuple(answer_of(*a)) for a in answers] == want
    waits = [(p, w) for p in (0, 1, 5, 70) for w in (None, 0.0, 12.5, 1e9)]
    table = spark.createDataFrame(waits, "prior int, wait double").select(delivery.backoff_seconds(F.col("prior"), F.col("wait")).alias("s"))
    assert [wait_seconds(p, w, Policy()) for p, w in waits] == [r.s for r in table.collect()]
