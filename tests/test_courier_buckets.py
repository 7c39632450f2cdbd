"""What the delivery machine asks of its state store, and when it gives up waiting."""

from types import SimpleNamespace

from pyspark.sql import Row

from rillflow.streaming import Policy, Target
from rillflow.streaming.courier import _Machine


class Handle:
    """A state store in memory that counts what is asked of it."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, set(), 0

    def getValueState(self, name, schema, ttl=None):
        def call(of):
            def counted(*args):
                self.calls += 1
                return of(*args)
            return counted

        return SimpleNamespace(
            get=call(lambda: self.values.get(name)), update=call(lambda v: self.values.__setitem__(name, v)), clear=call(lambda: self.values.pop(name, None)),
        )

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def at(ms):
    return SimpleNamespace(getCurrentProcessingTimeInMs=lambda: ms)


def queued(seq, n):
    return [Row(sink_key="s", event_id=f"e{i}", seq=seq, event_hash="h", headers={"N": str(i)}, body="b", at_ms=0) for i in range(n)]


def test_a_bucket_of_deliveries_is_few_calls():
    handle = Handle()
    machine = _Machine({"s": Target("u", lambda url, h, b: (503, "0", None) if h["N"] == "3" and h["X-Attempt"] == "1" else (200, None, None))}, Policy())
    machine.init(handle)
    made = list(machine.handleInputRows(("s", 0), iter(queued(1, 1000)), at(5)))
    assert len(made) == 1000 and [r.event_id for r in made if r.status == "failed"] == ["e3"]
    assert handle.calls < 10 and handle.timers == {6}
    # What comes twice is not sent again; what is newer is.
    assert list(machine.handleInputRows(("s", 0), iter(queued(1, 1000)), at(5))) == []
    fired = handle.timers.pop()
    again = list(machine.handleExpiredTimer(("s", 0), at(7), SimpleNamespace(getExpiryTimeInMs=lambda: fired)))
    assert [(r.event_id, r.status, r.attempts) for r in again] == [("e3", "delivered", 2)]
    assert "requests" not in handle.values and len(handle.timers) == 1
    assert [(r.event_id, r.seq) for r in machine.handleInputRows(("s", 0), iter(queued(2, 2)), at(8))] == [("e0", 2), ("e1", 2)]
