"""The state store is called per bucket of refs, not per ref."""

import pandas as pd

from sievework.streaming import monitor


class Store:
    def __init__(self):
        self.calls, self.rows, self.timers = 0, None, set()

    def _count(self, x=None):
        self.calls += 1
        return x

    def getListState(self, *_):
        return self

    def exists(self):
        return self._count(self.rows is not None)

    def get(self):
        return iter(self._count(self.rows))

    def put(self, rows):
        self.rows = self._count(rows)

    def clear(self):
        self.rows = self._count()

    def listTimers(self):
        return iter(self._count(sorted(self.timers)))

    def deleteTimer(self, t):
        self._count(self.timers.remove(t))

    def registerTimer(self, t):
        self._count(self.timers.add(t))


class Time:
    def __init__(self, expired, watermark):
        self.getExpiryTimeInMs, self.getCurrentWatermarkInMs = lambda: expired, lambda: watermark


def test_a_bucket_of_many_refs():
    store, made = Store(), monitor.OneShot()
    made.init(store)
    polls = pd.DataFrame([(f"r{k}", 1000 * k, "COMPLETE" if k % 2 else "RUNNING", 0, 10_000_000 + 1000 * k, 1.0) for k in range(1000)], columns=["ref", "poll_us", "status", "sent_us", "deadline_us", "score"])
    first = pd.concat(made.handleInputRows((0,), iter([polls]), None))
    assert sorted(first["ref"]) == sorted(f"r{k}" for k in range(1, 1000, 2)) and store.timers == {10_000}
    second = pd.concat(made.handleExpiredTimer((0,), Time(0, 10_501), Time(10_000, 0)))
    assert list(second["event"].unique()) == ["GAVE_UP"] and len(second) == 251 and store.timers == {10_502}
    assert store.calls < 20
