"""Streaming ingestion, commits, replay and delivery passes over a store."""

import json

import pytest
from pyspark.sql import functions as F

from rillflow.operators.store import Store, export_snapshot, upgrade_legacy
from rillflow.schemas import RAW_PAYLOADS
from rillflow.sources.payloads import stream_payloads
from rillflow.sources.registry import default_sources
from rillflow.streaming import Delivery, Ingest, activity_by_hour, first_versions


def feed(items):
    return json.dumps({"version": "https://jsonfeed.org/version/1.1", "title": "T", "items": items})


def item(i, text):
    return {"id": f"i{i}", "content_text": text, "url": f"https://x/{i}", "date_published": "2024-01-01T00:00:00Z"}


def land(spark, path, payload_id, body, status=200, source_type="jsonfeed"):
    row = (
        payload_id, 0, source_type, "jsonfeed", "a", "https://x/feed", status, {"ETag": f"e{payload_id}"}, body,
        None, 1,
    )
    df = spark.createDataFrame([row], RAW_PAYLOADS).withColumn(
        "fetched_at", F.timestamp_seconds(F.lit(1_704_067_200 + payload_id * 60))
    )
    df.coalesce(1).write.mode("append").parquet(path)


def run(ingest, spark, landing, checkpoint):
    q = ingest.start(stream_payloads(spark, landing), checkpoint)
    q.awaitTermination(240)


def state(store):
    rows = store.current("signals", ["seq"]).select("id", "content", "event_hash").collect()
    return sorted(map(tuple, rows))


def test_ingest_and_delivery(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), Store(spark, str(tmp_path / "store"))
    land(spark, landing, 1, feed([item(1, "one"), item(2, "two")]))
    ingest = Ingest(store, default_sources(), ["archive"])
    run(ingest, spark, landing, str(tmp_path / "ck"))
    assert [r[1] for r in state(store)] and len(state(store)) == 2

    land(spark, landing, 2, feed([item(1, "one"), item(2, "TWO"), item(3, "three")]))
    land(spark, landing, 3, feed([item(9, "x")]), status=304)
    land(spark, landing, 4, "{broken", status=200)
    run(ingest, spark, landing, str(tmp_path / "ck"))
    assert sorted(r[1] for r in state(store)) == ["TWO", "one", "three"]
    pending = store.current("deliveries").filter("status = 'pending'").count()
    assert pending == 3
    health = store.current("source_health").collect()[0]
    assert (health["status"], health["consecutive_failures"], health["total_runs"], health["total_events"]) == (
        "degraded", 1, 4, 5,
    )
    cursor = json.loads(store.current("checkpoints").collect()[0]["cursor_json"])
    assert cursor["source_key"] == "jsonfeed:a"

    def send(url, headers, body):
        text = json.loads(body)["content"]
        if text == "TWO":
            return 503, "7", None
        return (400, None, None) if text == "three" else (200, None, None)

    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    done = Delivery(store, "archive", "https://sink", send).run_pass(0, now).collect()[0]
    assert (done["attempted"], done["delivered"], done["failed"], done["dead"]) == (3, 1, 1, 1)
    again = Delivery(store, "archive", "https://sink", None).run_pass(0, now).collect()[0]
    assert again == done
    rows = {r["status"]: r for r in store.current("deliveries").collect()}
    assert rows["failed"]["next_attempt_at"].isoformat() == "2030-01-01T00:00:07"
    assert rows["dead"]["last_error"] == "webhook HTTP 400"

    # An update queues a delivered event again.
    land(spark, landing, 5, feed([item(1, "one more")]))
    run(ingest, spark, landing, str(tmp_path / "ck"))
    assert store.current("deliveries").filter("status = 'pending' AND attempts = 0").count() == 1

    before = state(store)
    store.compact("signals", ["seq"])
    assert state(store) == before
    land(spark, landing, 6, feed([item(4, "four")]))
    run(ingest, spark, landing, str(tmp_path / "ck"))
    assert len(state(store)) == 4

    report = export_snapshot(spark, {"signals": store.current("signals", ["seq"])}, str(tmp_path / "snap"))
    assert report.collect()[0]["row_count"] == 4
    with pytest.raises(FileExistsError):
        export_snapshot(spark, {"signals": store.current("signals", ["seq"])}, str(tmp_path / "snap"))


def test_batch_boundaries_do_not_matter(spark, tmp_path):
    bodies = [feed([item(i % 3, f"v{i // 2}"), item(9, "same")]) for i in range(4)]
    ends = []
    for name, files in (("a", 2), ("b", 4)):
        landing, store = str(tmp_path / name), Store(spark, str(tmp_path / f"store-{name}"))
        for i, body in enumerate(bodies):
            land(spark, landing, i, body)
        ingest = Ingest(store, default_sources())
        q = ingest.start(stream_payloads(spark, landing, max_files=files), str(tmp_path / f"ck-{name}"))
        q.awaitTermination(240)
        ends.append(state(store))
    # Files land in order, and the last version of an id wins in either split.
    assert ends[0] == ends[1]


def test_uncommitted_batch_is_invisible_and_replay_is_idempotent(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), Store(spark, str(tmp_path / "store"))
    land(spark, landing, 1, feed([item(1, "one")]))
    payloads = spark.read.schema(RAW_PAYLOADS).parquet(landing)
    ingest = Ingest(store, default_sources(), ["archive"])
    ingest._stage(payloads, 0)
    ingest._derive(payloads, 0)
    assert store.current("signals", ["seq"]).count() == 0
    assert store.current("deliveries").count() == 0
    ingest.process(payloads, 0)
    first = state(store)
    ingest.process(payloads, 0)
    assert state(store) == first and len(first) == 1
    assert store.commits().count() == 1


def test_backfill_of_new_sink(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), Store(spark, str(tmp_path / "store"))
    land(spark, landing, 1, feed([item(1, "one"), item(2, "two")]))
    payloads = spark.read.schema(RAW_PAYLOADS).parquet(landing)
    ingest = Ingest(store, default_sources(), ["archive"])
    ingest.process(payloads, 0)
    ingest.backfill_sink("late", 0)
    got = store.current("deliveries").groupBy("sink_key").count().collect()
    assert sorted(map(tuple, got)) == [("archive", 2), ("late", 2)]


def test_streaming_windows(spark, tmp_path):
    rows = [(f"s{i % 3}", "x", "h", i * 1200) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, source string, event_hash string, at long").select(
        "id", "source", "event_hash", F.timestamp_seconds("at").alias("collected_at")
    )
    path = str(tmp_path / "in")
    df.write.parquet(path)
    for name, fn, mode in (("act", activity_by_hour, "complete"), ("first", first_versions, "append")):
        stream = fn(spark.readStream.schema(df.schema).parquet(path))
        q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("act").agg(F.sum("signals")).collect()[0][0] == 30
    assert spark.table("first").count() == 3


def test_future_layout_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path), version=2)
    with pytest.raises(ValueError):
        upgrade_legacy(spark.range(1))


@pytest.fixture
def place(spark, tmp_path):
    """A store with one sink, and a function that lands a body and ingests it."""
    store = Store(spark, str(tmp_path / "store"))
    ingest = Ingest(store, default_sources(), ["archive"])

    def step(payload_id, body, status=200):
        path = str(tmp_path / f"landing-{payload_id}")
        land(spark, path, payload_id, body, status)
        ingest.process(spark.read.schema(RAW_PAYLOADS).parquet(path), payload_id)

    return store, step


def test_checkpoint_moves_only_with_good_polls(place):
    store, step = place
    cursor = lambda: json.loads(store.current("checkpoints").collect()[0]["cursor_json"])["state"]["payload_id"]
    error = lambda: store.current("checkpoints").collect()[0]["last_error"]
    step(1, feed([item(1, "one")]))
    assert (cursor(), error()) == (1, None)
    step(2, "oops", status=500)
    assert (cursor(), error()) == (1, "HTTP 500")
    step(3, "", status=304)
    assert (cursor(), error()) == (1, "HTTP 500")
    step(4, "{broken")
    assert cursor() == 1 and error() == "feed body is no JSON"
    step(5, feed([item(1, "two")]))
    assert (cursor(), error()) == (5, None)


def test_undated_items_are_no_change(place):
    store, step = place
    undated = [{"id": "u", "content_text": "same", "url": "https://x/u"}]
    step(1, feed(undated))
    first = store.current("signals", ["seq"]).collect()[0]
    step(2, feed(undated))
    assert store.read_batch("changes", store.spark.read.parquet(store.path("changes", "ingest", 2)).schema, "ingest", 2).collect()[0]["change"] == "unchanged"
    assert store.current("signals", ["seq"]).collect()[0]["created_at"] == first["created_at"]


def test_comments_a_batch_after_their_issue(spark, place):
    store, _ = place
    ingest = Ingest(store, default_sources())
    repo = "https://api.x/repos/r"
    search = json.dumps({"items": [{"node_id": "N7", "number": 7, "title": "t", "repository_url": repo, "html_url": "https://x/7", "created_at": "2024-01-01T00:00:00Z"}]})
    known, unknown = (
        json.dumps([{"id": i, "body": f"c{i}", "created_at": "2024-01-02T00:00:00Z"} for i in ids]) for ids in (range(9), range(50, 53))
    )
    at = F.timestamp_seconds(F.lit(1_704_067_200))
    for batch, (url, body) in enumerate([("https://api.x/search", search), (f"{repo}/issues/7/comments", known), (f"{repo}/issues/8/comments", unknown)]):
        row = (batch, 0, "github", "github", "a", url, 200, {}, body, None, 1)
        ingest.process(spark.createDataFrame([row], RAW_PAYLOADS).withColumn("fetched_at", at), batch)
    rows = store.current("signals", ["seq"]).collect()
    issue = next(r["id"] for r in rows if r["kind"] == "issue")
    parents = [json.loads(r["metadata_json"])["parent_event_id"] for r in rows if r["kind"] == "comment"]
    assert sorted(parents, key=str) == sorted([issue] * 9 + [None] * 3, key=str)


def test_version_moved_while_a_pass_sends(spark, place):
    """An event that changes after it was read stays pending; only an event that is absent is dead."""
    store, step = place
    step(1, feed([item(1, "one")]))
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")

    class Racing(Delivery):
        def _outcomes(self, due, pass_id, at):
            if not moved:
                moved.append(True)
                step(2, feed([item(1, "two")]))
            super()._outcomes(due, pass_id, at)

    for answer in ((200, None, None), (500, None, None)):
        moved = []
        got = Racing(store, "archive", "https://sink", lambda *_: answer).run_pass(len(answer) + answer[0], now).collect()[0]
        assert got["superseded" if answer[0] == 200 else "failed"] == 1
        row = store.current("deliveries").collect()[0]
        if answer[0] == 200:
            assert (row["status"], row["attempts"]) == ("pending", 0)


def test_two_committers_never_share_a_version(spark, tmp_path):
    from rillflow.operators.store import Conflict, create_path

    store = Store(spark, str(tmp_path / "store"))
    assert store.commit("a", 0) == 1
    seen = store.version()
    create_path(spark, f"{store.path('claims')}/version=2")  # another committer is about to commit
    with pytest.raises(Conflict):
        store.commit("b", 0, after=seen)
    assert store.commit("b", 0) == 3 and store.commit("b", 0) == 3


def test_console_prints_every_event(spark, place, capsys):
    from rillflow.operators.sinks import write_console

    store, step = place
    step(1, feed([item(i, f"t{i}") for i in range(45)]))
    write_console(store.current("signals", ["seq"]))
    assert len({json.loads(x)["id"] for x in capsys.readouterr().out.splitlines()}) == 45
