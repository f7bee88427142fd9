"""Last results in buckets: the same changes as one state per sighting, few entries of state, and expiry of each by itself."""

import datetime as dt
import random

import pandas as pd

from sightline.streaming import feeds
from test_keyed_state import RESULTS, hours, slices


def plain(batches):
    known, out = {}, []
    for k, rows in enumerate(batches):
        last = {}
        for i, status, risk, ts in rows:
            found = (ts is not None, ts or dt.datetime.min, status, risk is not None, risk or "")
            last[i] = max(last.get(i, found), found)
        for i, found in last.items():
            before = known.get(i)
            if before is None or found > before:
                known[i] = found
                if before is None or before[2:] != found[2:]:
                    done = found[2] == "completed" and (before is None or before[2] != "completed")
                    out.append((k, i, found[2], found[4] or None, found[1] if found[0] else None, feeds.DONE if done else None))
    return sorted(out, key=repr)


def test_buckets_hold_many_sightings(spark, tmp_path):
    rng = random.Random(3)
    batches = [
        [(rng.randrange(-40, 200), rng.choice(["completed", "failed"]), rng.choice(["Low", "High", None]), rng.choice([None, *map(hours, range(9))])) for _ in range(300)]
        for _ in range(3)
    ]
    got = slices(spark, tmp_path, batches, RESULTS, lambda s: feeds.stream_status(s, buckets=5))
    order = {b: k for k, b in enumerate(sorted({r.batch for r in got}))}  # batches without rows take numbers, too
    assert sorted(((order[r.batch], r.sighting_id, r.status, r.risk_level, r.ts, r.event) for r in got), key=repr) == plain(batches)
    assert spark.read.format("statestore").load(str(tmp_path / "out" / "_state")).count() == 5


class State:
    """What a step asks of the state of a group."""

    def __init__(self):
        self.held, self.now, self.timeout, self.hasTimedOut = None, 0, None, False

    exists = property(lambda self: self.held is not None)
    get = property(lambda self: self.held)

    def getCurrentWatermarkMs(self):
        return self.now

    def update(self, held):
        self.held = held

    def setTimeoutTimestamp(self, at):
        assert at >= self.now
        self.timeout = at

    def remove(self):
        self.held = self.timeout = None


def test_each_sighting_expires_by_itself():
    step, state = feeds._last_status(100), State()

    def run(now, *rows):
        state.now, state.hasTimedOut = now, not rows
        parts = [pd.DataFrame(rows, columns=["sighting_id", "at", "status", "risk_level", "arrived"])] if rows else []
        return [tuple(r) for part in step((0,), iter(parts), state) for r in part.itertuples(index=False)]

    assert run(0, (1, 5, "failed", None, 10)) == [(1, "failed", None, 5, None)]
    assert run(0, (2, 5, "completed", "Low", 60)) == [(2, "completed", "Low", 5, feeds.DONE)]
    assert state.timeout == 110 and state.held[0] == [1, 2]
    assert run(111) == [] and state.held[0] == [2] and state.timeout == 160
    assert run(111, (1, 4, "failed", None, 120)) == [(1, "failed", None, 4, None)]  # forgotten, so it is new
    assert run(161, (2, 4, "failed", "Low", 170)) == [] and state.held[0] == [1]  # late, and then forgotten
    assert run(221) == [] and state.held is None
