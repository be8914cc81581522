"""Debouncing and merging by pointers against the plain fold, on regular, bursty and tied input, in a fixed number of jobs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tendon.operators import events, steps

NAMES = ("index_press", "index_release", "middle_release", "thumb_up")


def folded(step, start, rows):
    state, out = start, []
    for r in rows:
        state, made = step(state, r)
        out += made
    return out


def cases():
    rng = random.Random(8)
    regular = [(0, 10 * i, "thumb_up") for i in range(700)]
    bursty, t = [], 0
    for _ in range(600):
        t += rng.choice([0, 1, 2, 400])
        bursty.append((1, t, rng.choice(NAMES)))
    tied = [(2, t, name) for t in range(0, 300, 3) for name in rng.sample(NAMES, 2) for _ in range(rng.randint(1, 2))]
    return {"regular": regular, "bursty": bursty, "tied": tied, "all": regular + bursty + tied + [(3, 7, "thumb_up")]}


@pytest.mark.parametrize("case", ["regular", "bursty", "tied", "all"])
@pytest.mark.parametrize(("releases", "older"), [(steps.RELEASES, False), (steps.RELEASES, True), ((), False)])
def test_debounce_equals_the_fold(spark, case, releases, older):
    rows = cases()[case]
    want = []
    for k in {r[0] for r in rows}:
        own = [{"t": t, "name": n} for t, n in sorted((t, n) for key, t, n in rows if key == k)]
        want += [(k, *o) for o in folded(steps.debounce(25, releases, older), None, own)]
    df = spark.createDataFrame(rows, "k int, t bigint, name string").withColumn("c", F.floor(F.col("t") / 500)).repartition(5)
    got = events.debounce(df, ["k"], "c", 25, releases, older, chunk_rows=64)
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("minimum", [0, 1, 40, 10_000])
def test_merge_equals_the_fold(spark, minimum):
    rng = random.Random(2)
    rows = [(k, n, rng.choice([0, 1, 7, 30]) if k else 10) for k in range(3) for n in range(400)]
    want = {}
    for k in range(3):
        own = [{"n": n, "len": x} for key, n, x in rows if key == k]
        for n, first in folded(steps.merge_prompts(minimum), [0, 0], own):
            want.setdefault((k, first), []).append(n)
    df = spark.createDataFrame(rows, "k int, n bigint, len bigint").select("*", F.floor(F.col("n") / 50).alias("c"), F.format_string("%d,", "n").alias("text"), F.col("n").alias("start"), F.col("n").alias("end"))
    got = {(r.k, r.first): [int(x) for x in r.text.split(",")[:-1]] for r in events.merge_prompts(df.repartition(5), ["k"], "c", minimum, chunk_rows=32).collect()}
    if minimum == 0:  # every row stands alone
        assert got == {(k, n): [n] for k, n, _ in rows}
    else:
        assert got == want


def test_jobs_do_not_grow_with_the_chunks(spark):
    """Regular input made the fold refold one chunk after the other."""
    df = spark.range(4000).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("t"), F.lit("thumb_up").alias("name"), F.floor(F.col("id") / 100).alias("c"))
    used = []
    for rows in (2000, 20):
        tag = f"jumps-{rows}"
        spark.sparkContext.setJobGroup(tag, tag)
        assert events.debounce(df, ["k"], "c", 25, chunk_rows=rows).count() == 1334
        used.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag)))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert used[1] <= used[0] + 2
