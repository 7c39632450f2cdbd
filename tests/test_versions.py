"""Deliveries laid out by status, reading as of a version, and snapshots taken while others commit."""

import pytest
from pyspark.sql import functions as F

from rillflow.operators import delivery
from rillflow.operators.store import Store, export_state, exported
from rillflow.schemas import DELIVERIES, SIGNALS
from rillflow.streaming import Delivery


def rows(spark, *told):
    """(event, status) pairs as delivery rows of one sink."""
    at = F.timestamp_seconds(F.lit(1_704_067_200))
    frame = spark.createDataFrame(list(told), "event_id string, status string")
    more = {"sink_key": F.lit("s"), "attempts": F.lit(0), "updated_at": at, "next_attempt_at": F.lit(None).cast("timestamp"), "last_error": F.lit(None).cast("string"), "delivered_at": F.lit(None).cast("timestamp")}
    return frame.withColumns(more).select(*DELIVERIES.fieldNames())


def told(frame):
    return sorted((r["event_id"], r["status"]) for r in frame.collect())


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def moved(spark, tmp_path):
    """Two commits, a base, and a commit that closes an open row, opens a closed one and adds one."""
    store = Store(spark, str(tmp_path / "s"))
    store.commit("a", 0, {"deliveries": rows(spark, ("open", "pending"), ("closing", "failed"), ("dead", "pending"))})
    store.commit("a", 1, {"deliveries": rows(spark, ("done", "delivered"), ("dead", "dead"), ("opening", "delivered"))})
    assert store.compact("deliveries") == store.compact("deliveries") == 2
    store.commit("a", 2, {"deliveries": rows(spark, ("closing", "delivered"), ("opening", "pending"), ("new", "pending"))})
    return store


def test_open_rows_need_no_closed_folder(moved):
    got = moved.current("deliveries", among=delivery.OPEN)
    assert told(got) == [("new", "pending"), ("open", "pending"), ("opening", "pending")]
    assert told(got) == told(moved.current("deliveries").filter(F.col("status").isin(*delivery.OPEN)))
    assert "PartitionFilters: [status" in plan(got) and "pending" in plan(got).split("PartitionFilters: [status")[1][:80]
    assert [r[0] for r in moved.current("deliveries", names=["attempts"]).select("event_id").orderBy("event_id").collect()] == ["closing", "dead", "done", "new", "open", "opening"]
    with pytest.raises(ValueError):
        moved.current("signals", among=("x",))


def test_state_as_of_a_version(moved):
    first = [("closing", "failed"), ("dead", "pending"), ("open", "pending")]
    second = [("closing", "failed"), ("dead", "dead"), ("done", "delivered"), ("open", "pending"), ("opening", "delivered")]
    assert told(moved.current("deliveries", as_of=1)) == first
    assert told(moved.current("deliveries", as_of=2)) == second
    assert told(moved.current("deliveries", as_of=0)) == []
    moved.compact("deliveries")
    assert told(moved.current("deliveries", as_of=1)) == first and told(moved.current("deliveries", as_of=2)) == second
    assert not moved.compact_after("deliveries", 1) and moved.compact_after("deliveries", 0)


def test_snapshot_holds_one_version(spark, moved, tmp_path, monkeypatch):
    dest, current = str(tmp_path / "snap"), Store.current

    def commit_meanwhile(self, table, *args, **kwargs):
        if table == "signals":
            self.commit("b", 0, {"deliveries": rows(spark, ("open", "delivered"))})
        return current(self, table, *args, **kwargs)

    monkeypatch.setattr(Store, "current", commit_meanwhile)
    report = export_state(moved, dest, {"signals": ["seq"], "deliveries": []})
    assert {(r["table_name"], r["version"], r["row_count"]) for r in report.collect()} == {("signals", 3, 0), ("deliveries", 3, 6)}
    assert moved.version() == 4
    assert told(exported(spark, dest, "deliveries")) == told(moved.current("deliveries", as_of=3))
    assert exported(spark, dest, "signals").schema == SIGNALS

    class Crash(Exception):
        pass

    def crash(self, table, *args, **kwargs):
        if table == "signals":
            raise Crash
        return current(self, table, *args, **kwargs)

    # A copy that breaks off publishes nothing; the next whole one is read, and the older one by its version.
    monkeypatch.setattr(Store, "current", crash)
    with pytest.raises(Crash):
        export_state(moved, dest, {"deliveries": [], "signals": ["seq"]})
    assert ("open", "pending") in told(exported(spark, dest, "deliveries"))
    export_state(moved, dest, {"deliveries": []})
    assert ("open", "delivered") in told(exported(spark, dest, "deliveries"))
    assert ("open", "pending") in told(exported(spark, dest, "deliveries", as_of=3))
    with pytest.raises(FileNotFoundError):
        exported(spark, dest, "checkpoints")


def test_passes_over_a_folded_table(spark, moved):
    """Closed rows stay closed, folds between passes lose nothing, and events that are gone die."""
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    worker = Delivery(moved, "s", "https://sink", None, limit=2, fold_after=1)
    for number, size in enumerate((2, 1, 0)):
        done = worker.run_pass(number, now).collect()[0] if size else None
        assert done is None or (done["attempted"], done["dead"]) == (size, size)
    want = [("closing", "delivered"), ("dead", "dead"), ("done", "delivered"), ("new", "dead"), ("open", "dead"), ("opening", "dead")]
    assert told(moved.current("deliveries")) == want
