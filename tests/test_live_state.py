"""What a key keeps in the state store is bounded by what may be late, not by the table."""

from __future__ import annotations

import pandas as pd
import pytest

from tendon.operators import steps
from tendon.operators.folds import by_row
from tendon.streaming import stateful as Z


class Value:
    def __init__(self):
        self.v, self.largest = None, 0

    def get(self):
        return self.v

    def update(self, v):
        self.v, self.largest = v, max(self.largest, len(v[4] or b""))


class Map:
    def __init__(self):
        self.d, self.largest, self.most = {}, 0, 0

    def updateValue(self, k, v):  # noqa: N802
        self.d[k] = v
        self.largest, self.most = max(self.largest, len(v[0])), max(self.most, len(self.d))

    def getValue(self, k):  # noqa: N802
        return self.d[k]

    def removeKey(self, k):  # noqa: N802
        del self.d[k]


class Handle:
    def __init__(self):
        self.value, self.map, self.timers = Value(), Map(), set()

    def getValueState(self, *_):  # noqa: N802
        return self.value

    def getMapState(self, *_):  # noqa: N802
        return self.map

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


def played(rows, batch, late):
    """Feed `rows` in batches, the watermark `late` behind; timers fire after each batch."""
    handle, out, mark = Handle(), [], 0
    machine = Z.Machine(["k", "t", "name", Z.AT], ["k"], ["t", "name"], by_row(steps.debounce(70), ("t", "name")), None, ["t", "name"], None, late * 1000 // Z.SLOTS)
    machine.init(handle)
    for at in range(0, len(rows) + 2 * batch, batch):
        part = rows[at:at + batch]
        if part:
            pdf = pd.DataFrame([(1, t, name, t * 1000) for t, name in part], columns=["a", "b", "c", "d"])
            out += [tuple(r) for f in machine.handleInputRows((1,), iter([pdf]), Clock(mark)) for r in f.to_numpy()]
        mark = max(mark, max(t for t, _ in part) - late if part else mark + 10**9)
        for t in sorted(x for x in handle.timers if x <= mark):
            handle.timers.discard(t)
            for f in machine.handleExpiredTimer((1,), Clock(mark), Clock(t)):
                out += [tuple(r) for r in f.to_numpy()]
    return handle, [r[1:] for r in out]


@pytest.mark.parametrize("size", [4_000, 16_000])
def test_state_is_bounded_whatever_the_table(size):
    import random
    rng = random.Random(size)
    rows = [(10 * i + 1, rng.choice(["index_press", "index_release", "thumb_up"])) for i in range(size)]
    late = 20_000  # 2,000 rows
    shuffled = [r for at in range(0, size, 1000) for r in rng.sample(rows[at:at + 1000], len(rows[at:at + 1000]))]
    handle, got = played(shuffled, 500, late)
    state, want = None, []
    for t, name in sorted(rows):
        state, made = steps.debounce(70)(state, {"t": t, "name": name})
        want += made
    assert got == want
    assert not handle.map.d  # all rows have left
    block = len(Z._packed(pd.DataFrame([(1, 10**6, "middle_release", 10**9)] * Z.BLOCK_ROWS, columns=["k", "t", "name", Z.AT])))
    assert handle.value.largest <= block and handle.map.largest <= block
    assert handle.map.most <= 3 * Z.SLOTS * 5  # blocks of what is late, for 4,000 rows as for 16,000


def test_slices_follow_the_largest_key(spark):
    d = spark.createDataFrame([(0, i) for i in range(900)] + [(k, 10 * k) for k in range(1, 50)], "k int, t bigint")
    assert Z.Replay(spark, d, "s", "t", keys=["k"]).slices == 4
    r = Z.Replay(spark, d, "s", "t", keys=["k"], slice_rows=50)
    assert r.slices >= 18
    most = spark.read.parquet(r.staged).groupBy("k", "__slice").count().agg({"count": "max"}).first()[0]
    assert most <= 50
    assert Z.Replay(spark, d.limit(0), "s", "t", keys=["k"]).slices >= 1


def test_short_keys_share_states(spark):
    """Hundreds of short keys are a few calls of Python, and every key still has its own machine."""
    import random

    from pyspark.sql import functions as F
    rng = random.Random(5)
    big = 2**53  # neighbours that no double tells apart
    rows = [(big + k, 10 * t + k % 7, rng.choice(["index_press", "index_release", "middle_press", "middle_release", "thumb_up"])) for k in range(300) for t in range(rng.randrange(1, 30))]
    d = spark.createDataFrame([*rows, (None, 55, "index_press")], "k bigint, t bigint, name string")
    r = Z.Replay(spark, d, "short", "t", keys=["k"])
    assert r.stream.groups == Z.GROUPS  # before, 301 states were called in every slice
    want, step = [], steps.press_release(15)
    for k in range(300):
        state = None
        for _, t, name in sorted(x for x in rows if x[0] == big + k):
            state, out = step(state, {"t": t, "name": name})
            want += [(big + k, *o) for o in out]
    made = Z.to_table(Z.press_release(r.stream, ["k"], 15), "short", r)
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, want))
    r = Z.Replay(spark, d, "apart", "t", keys=["k"])
    r.stream.groups = None  # a state a key: a row without key spoils none of those that come with it
    assert sorted(map(str, map(tuple, Z.to_table(Z.press_release(r.stream, ["k"], 15), "apart", r).collect()))) == sorted(map(str, want))
    c = spark.range(300 * 8).select((F.col("id") % 300 + big).alias("k"), F.floor(F.col("id") / 300).alias("n"), (F.col("id") % 11 + 1.0).alias("x"))
    r = Z.Replay(spark, c, "fits", "n", keys=["k"])
    got = {(a, b): x for a, b, x in Z.to_table(Z.calibrate_run(r.stream, ["k"], 3, ["x"]), "fits", r).collect()}
    of = {(row.k, row.n): row.x for row in c.collect()}
    assert got == pytest.approx({(k, n): x / (sorted(of[k, i] for i in range(3))[1] / 16) for (k, n), x in of.items() if n >= 3})
