"""Split scans, top-k and fan-out against brute force, with one key holding most rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rillflow.operators.changes import apply_changes, classify_changes, last_versions, write_counts
from rillflow.operators.delivery import fold_deliveries
from rillflow.operators.health import apply_health, fold_health, run_outcomes
from rillflow.plans import fan_out, previous_value, top_per_key, trailing_count
from rillflow.schemas import RATE_LIMIT, RUN_LOG, SIGNALS


def keys(rng, n):
    return ["hot" if rng.random() < 0.6 else f"k{rng.randrange(20)}" for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_previous_value(spark, chunk):
    rng = random.Random(chunk)
    rows = [(k, i, rng.choice("abc")) for i, k in enumerate(keys(rng, 500))]
    before = [("hot", "z"), ("k1", "y"), ("absent", "x")]
    last = dict(before)
    want = {}
    for k, i, v in rows:
        want[i] = last.get(k)
        last[k] = v
    df = spark.createDataFrame(rows, "k string, seq long, v string")
    start = spark.createDataFrame(before, "k string, v string")
    got = previous_value(df, ["k"], "seq", "v", "p", start, chunk).collect()
    assert {r["seq"]: r["p"] for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("chunk", [1, 5, 50, 1 << 20])
def test_trailing_count(spark, chunk):
    rng = random.Random(chunk)
    rows = [(k, i, rng.random() < 0.2) for i, k in enumerate(keys(rng, 600))]
    run, want = defaultdict(int), {}
    for k, i, ok in rows:
        run[k] = 0 if ok else run[k] + 1
        want[i] = run[k]
    df = spark.createDataFrame(rows, "k string, seq long, ok boolean").withColumn("bad", ~F.col("ok"))
    got = trailing_count(df, ["k"], "seq", "ok", "bad", "n", chunk).collect()
    assert {r["seq"]: r["n"] for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("k", [0, 3, 1500])
def test_top_per_key(spark, k):
    rng = random.Random(k)
    rows = [(key, rng.randrange(10**6) * 10_000 + i) for i, key in enumerate(keys(rng, 4000))]
    want = defaultdict(list)
    for key, v in rows:
        want[key].append(v)
    df = spark.createDataFrame(rows, "k string, v long")
    for limit in (k, F.lit(k)):
        got = defaultdict(list)
        for r in top_per_key(df, ["k"], [F.col("v").desc()], limit).orderBy("rank").collect():
            got[r["k"]].append(r["v"])
        assert dict(got) == {x: sorted(v, reverse=True)[:k] for x, v in want.items() if k}


def test_small_k_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    plan = top_per_key(df, ["k"], [F.col("id")], 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_fan_out_has_no_join(spark):
    df = spark.range(5)
    members = spark.createDataFrame([("a",), ("b",), ("a",)], "sink_key string")
    out = fan_out(df, members, "sink_key")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    assert out.count() == 10


def signals(spark, rows):
    """``(id, seq, content)`` as full signal rows whose hash is their content."""
    df = spark.createDataFrame(rows, "id string, seq long, content string")
    filled = {
        f.name: F.lit(None).cast(f.dataType)
        for f in SIGNALS.fields if f.name not in ("id", "content", "event_hash", "collected_at")
    }
    return df.withColumns(
        {**filled, "event_hash": F.col("content"), "collected_at": F.timestamp_seconds("seq")}
    )


def test_changes_follow_arrival_order(spark):
    batch = signals(spark, [("x", 0, "A"), ("x", 1, "A"), ("x", 2, "B"), ("x", 3, "A"), ("y", 4, "C"), ("z", 5, "N")])
    current = signals(spark, [("y", 0, "C"), ("z", 0, "O"), ("w", 0, "W")])
    for chunk in (1, 2, 1 << 20):
        changes = classify_changes(batch, current, chunk=chunk)
        got = [r["change"] for r in changes.orderBy("seq").collect()]
        assert got == ["inserted", "unchanged", "updated", "updated", "unchanged", "updated"]
    counts = write_counts(changes).collect()[0].asDict()
    assert counts == {"inserted": 1, "updated": 3, "unchanged": 2, "changed": 4}
    after = {r["id"]: (r["content"], r["collected_at"].second) for r in apply_changes(current, batch, changes).collect()}
    assert after == {"x": ("A", 3), "y": ("C", 0), "z": ("N", 5), "w": ("W", 0)}
    assert last_versions(batch, changes).count() == 2


def test_split_batches_end_alike(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice("ab")) for i, k in enumerate(keys(rng, 300))]
    ends = []
    for cuts in ([0, 300], [0, 50, 51, 200, 300]):
        state = signals(spark, [("none", 0, "n")]).drop("seq")
        for a, b in zip(cuts, cuts[1:]):
            batch = signals(spark, rows[a:b])
            changes = classify_changes(batch, state, chunk=16)
            state = apply_changes(state, batch, changes)
            state = spark.createDataFrame(state.collect(), state.schema)
        ends.append(sorted((r["id"], r["content"], r["collected_at"]) for r in state.collect()))
    assert ends[0] == ends[1]


def run_rows(rng, n):
    out = []
    for i, k in enumerate(keys(rng, n)):
        ok = rng.random() < 0.4
        out.append((i, k, None, None, ok, None if ok else "http", None if ok else f"e{i}", rng.randrange(9), None))
    return out


def runs_df(spark, rows):
    df = spark.createDataFrame(rows, RUN_LOG)
    at = F.timestamp_seconds("run_id")
    return df.withColumns({"attempted_at": at, "finished_at": at, "rate_limit": F.lit(None).cast(RATE_LIMIT)})


def test_health_folds_like_the_loop(spark):
    rng = random.Random(9)
    rows = run_rows(rng, 400)
    fails, runs, events, delays = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for i, k, _, _, ok, _, _, n, _ in rows:
        fails[k] = 0 if ok else fails[k] + 1
        runs[k] += 1
        events[k] += n if ok else 0
        delays[i] = 60.0 if ok else 300.0 if fails[k] >= 2 else 5.0
    got = run_outcomes(runs_df(spark, rows), threshold=2, chunk=16).collect()
    assert {r["run_id"]: r["delay"] for r in got} == delays
    early = fold_health(runs_df(spark, rows[:150]), threshold=2)
    late = fold_health(runs_df(spark, rows[150:]), early, threshold=2)
    table = {r["source_key"]: r for r in apply_health(early, late).collect()}
    for k in runs:
        r = table[k]
        status = "healthy" if fails[k] == 0 else "circuit_open" if fails[k] >= 2 else "degraded"
        assert (r["consecutive_failures"], r["total_runs"], r["total_events"], r["status"]) == (
            fails[k], runs[k], events[k], status,
        )
    resumed = run_outcomes(runs_df(spark, rows[150:]), early, threshold=2, chunk=16).collect()
    assert {r["run_id"]: r["delay"] for r in resumed} == {i: d for i, d in delays.items() if i >= 150}


def test_delivery_fold_follows_the_state_machine(spark):
    rng = random.Random(3)
    queue, tries, want = [], [], {}
    for n in range(40):
        key, seq, state, version = f"e{n}", 0, None, 0
        for _ in range(rng.randrange(1, 12)):
            seq += 1
            if state is None or rng.random() < 0.25:
                version += 1
                queue.append(("s", key, f"v{version}", seq, seq))
                state = ["pending", 0]
                continue
            if state[0] in ("dead", "delivered"):
                continue
            sent = f"v{rng.choice([version, max(1, version - 1)])}"
            outcome = rng.choice(["success", "retryable", "retryable", "permanent"])
            tries.append((seq, "s", key, sent, outcome))
            if outcome == "success" and sent != f"v{version}":
                continue
            state[1] += 1
            dead = outcome == "permanent" or state[1] >= 3
            state[0] = "delivered" if outcome == "success" else "dead" if dead else "failed"
        want[key] = tuple(state)
    q = spark.createDataFrame(queue, "sink_key string, event_id string, event_hash string, seq long, at long")
    a = spark.createDataFrame(tries, "seq long, sink_key string, event_id string, sent_hash string, outcome string")
    a = a.withColumns(
        {"retry_after": F.lit(None).cast("double"), "error": F.lit("x"), "attempted_at": F.timestamp_seconds("seq")}
    )
    rows = fold_deliveries(q.withColumn("at", F.timestamp_seconds("at")), a, max_attempts=3).collect()
    assert {r["event_id"]: (r["status"], r["attempts"]) for r in rows} == want


def test_windows_are_not_over_whole_keys(spark):
    """The first window of a split scan partitions by key and interval."""
    df = spark.range(10).select(F.lit("k").alias("k"), F.col("id").alias("seq"), F.lit("v").alias("v"))
    plan = previous_value(df, ["k"], "seq", "v", "p")._jdf.queryExecution().optimizedPlan().toString()
    assert "_interval" in plan


def test_changes_of_an_event_in_every_payload(spark):
    """Order numbers as the stream makes them: one hot id in each of many payloads, in few slices."""
    rng = random.Random(9)
    rows = [("hot" if pos == 0 else f"k{rng.randrange(40)}", payload * (1 << 20) + pos, rng.choice("ab")) for payload in range(5000, 6500) for pos in range(2)]
    want, last = {}, {}
    for key, seq, value in rows:
        want[seq] = "inserted" if key not in last else "unchanged" if last[key] == value else "updated"
        last[key] = value
    df = spark.createDataFrame(rows, "id string, seq long, event_hash string")
    none = spark.createDataFrame([], "id string, event_hash string")
    for chunk in ((1 << 20) * 8, 1 << 20):
        got = classify_changes(df, none, carry=(), chunk=chunk).collect()
        assert {r["seq"]: r["change"] for r in got} == want
