"""Ordered scans, quantiles, joins and folds against plain restatements; chunked equals unchunked."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tendon.operators import events as E
from tendon.operators import sequences as S
from tendon.operators import steps
from tendon.operators.folds import by_row, chunked_fold
from tendon.operators.joins import interval_join
from tendon.operators.ordered import exact_quantiles, index, running, scan, weighted_medians

RNG = np.random.default_rng(5)


def hot_rows(n=600):
    """A third of all rows belongs to one key."""
    key = np.where(RNG.random(n) < 0.34, 0, RNG.integers(1, 6, n))
    return pd.DataFrame({"k": key, "i": np.arange(n), "v": np.where(RNG.random(n) < 0.2, np.nan, RNG.normal(size=n).round(3)), "w": RNG.integers(1, 4, n)})


@pytest.mark.parametrize("levels", [[], [["b"]], [["a"], ["a", "b"]]])
def test_scan_equals_window(spark, levels):
    d = spark.createDataFrame(hot_rows()).withColumns({"v": F.when(F.isnan("v"), None).otherwise(F.col("v")), "b": F.floor(F.col("i") / 7), "a": F.floor(F.col("i") / 70)})
    out = {"n": index(), "s": running("sum", "w"), "mx": running("max", "v"), "lst": running("last", "v"), "lag": running("lag", "v"), "lead": running("lead", "v"),
           "nxt": running("first_after", "v"), "mn": running("min_from", "v"), "mb": running("max_before", "v")}
    got = scan(d, ["k"], ["i"], out, levels).toPandas().sort_values("i")
    w = Window.partitionBy("k").orderBy("i")
    pre, suf = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    want = d.select("i", (F.row_number().over(w) - 1).alias("n"), F.sum("w").over(w).alias("s"), F.max("v").over(w).alias("mx"), F.last("v", True).over(w).alias("lst"),
                    F.lag("v").over(w).alias("lag"), F.lead("v").over(w).alias("lead"), F.first("v", True).over(suf).alias("nxt"),
                    F.min("v").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("mn"), F.max("v").over(pre).alias("mb")).toPandas().sort_values("i")
    for c in out:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), equal_nan=True)


def test_exact_quantiles_and_weighted_median(spark):
    p = hot_rows().dropna()
    d = spark.createDataFrame(p)
    got = exact_quantiles(d, ["k"], "v", {"a": 0.5, "b": 0.95}).toPandas().set_index("k")
    for k, g in p.groupby("k"):
        np.testing.assert_allclose(got.loc[k], np.percentile(g["v"], [50, 95]))
    med = weighted_medians(d, ["k"], "v", "w", "m").toPandas().set_index("k")["m"]
    for k, g in p.groupby("k"):
        g = g.sort_values("v")
        assert med[k] == g["v"].to_numpy()[np.searchsorted(np.cumsum(g["w"]), 0.5 * g["w"].sum())]


def test_interval_join(spark):
    p = spark.createDataFrame(pd.DataFrame({"k": RNG.integers(0, 3, 200), "t": RNG.integers(0, 500, 200)}))
    s = spark.createDataFrame(pd.DataFrame({"k": RNG.integers(0, 3, 40), "a": (a := RNG.integers(0, 500, 40)), "b": a + RNG.integers(0, 90, 40)}))
    got = interval_join(p, s, ["k"], "t", "a", "b", 16).count()
    p, s = p.toPandas(), s.toPandas()
    assert got == sum(((p.k == r.k) & (p.t >= r.a) & (p.t < r.b)).sum() for r in s.itertuples())


def folded(spark, rows, step, names, start, schema, order, size):
    d = spark.createDataFrame(rows).withColumn("c", F.floor(F.monotonically_increasing_id() * 0 + F.col(order[0]) / size))
    return sorted(map(tuple, chunked_fold(d, ["k"], order, "c", by_row(step, names), start, schema).collect()), key=str)


@pytest.mark.parametrize("case", ["debounce", "phases", "open", "press", "audit", "gesture", "ema"])
def test_chunked_fold_equals_one_pass(spark, case):
    n = 400
    k = np.where(RNG.random(n) < 0.4, 0, RNG.integers(1, 4, n))
    t = np.cumsum(RNG.integers(1, 9, n))
    names = RNG.choice(["index_press", "index_release", "middle_press", "middle_release", "thumb_up"], n)
    rows = pd.DataFrame({"k": k, "t": t, "n": t, "name": names, "label": RNG.integers(-1, 3, n), "seq": (np.arange(n) + RNG.choice([0, 0, 0, -2, 3], n)) % 256,
                         "id": np.arange(n), "gesture": RNG.integers(0, 3, n), "x": RNG.normal(size=n)})
    step, out, start, schema = {
        "debounce": (steps.debounce(20), ("t", "name"), None, "t bigint, name string"),
        "phases": (steps.phase_tracker(), ("n", "stable", "phase"), [0, 0, 0, 0], "n bigint, stable int, phase int"),
        "open": (steps.open_tracker(open_label=2, release_after=3), ("n", "stable", "phase"), [[0, 0, 0, 0], 0], "n bigint, stable int, phase int"),
        "press": (steps.press_release(30), ("t", "name", "synthetic", "held", "hold_ok"), None, "t bigint, name string, synthetic boolean, held bigint, hold_ok boolean"),
        "audit": (steps.sequence_audit, ("t", "lost_before", "duplicate", "late"), None, "t bigint, lost_before int, duplicate boolean, late boolean"),
        "gesture": (steps.gesture_frames(15), ("t", "id", "gesture", "left"), steps.GESTURE_START, "t bigint, id bigint, gesture int, left int"),
        "ema": (steps.blend(0.28), ("n", "y"), None, "n bigint, y double"),
    }[case]
    one = folded(spark, rows, step, out, start, schema, ["t"], 10 ** 9)
    assert folded(spark, rows, step, out, start, schema, ["t"], 60) == one
    want = []
    for key, g in rows.groupby("k"):
        state = start
        for r in g.sort_values("t").to_dict("records"):
            state, made = step(state, r)
            want += [(key, *m) for m in made]
    assert len(one) == len(want)


def test_debounce_rules():
    def kept(step, events):
        state, out = None, []
        for name, t in events:
            state, made = step(state, {"name": name, "t": t})
            out += [m[1] for m in made]
        return out
    near = [("index_release", 10), ("thumb_click", 20)]
    assert kept(steps.debounce(50), near) == ["index_release"]
    assert kept(steps.debounce(50, keep_after_release=True), near) == ["index_release", "thumb_click"]
    assert kept(steps.debounce(50), [("index_press", 0), ("index_release", 10), ("index_release", 20)]) == ["index_press", "index_release"]


def test_greedy_match_brute_force(spark):
    p, g = (pd.DataFrame({"k": RNG.integers(0, 3, m), "t": RNG.permutation(600)[:m]}) for m in (70, 60))
    got = {(r.k, r.pred_t): r.truth_t for r in E.match_events(spark.createDataFrame(p), spark.createDataFrame(g), ["k"], "t", 9, F.floor(F.col("t") / 50)).collect()}
    for key in range(3):
        truth, used = sorted(g[g.k == key].t), set()
        for t in sorted(p[p.k == key].t):
            near = min(((abs(t - x), i) for i, x in enumerate(truth) if i not in used), default=None)
            hit = near is not None and near[0] <= 9
            if hit:
                used.add(near[1])
            assert got[(key, t)] == (truth[near[1]] if hit else None)


def test_sweep_equals_matching_every_threshold(spark, monkeypatch):
    """Counts as by brute force, and only steps that have a truth in reach are folded; before, all were."""
    from tendon.operators import matching
    rng = np.random.default_rng(8)
    f = pd.DataFrame([(k, c, n, float(rng.integers(0, 10)) / 10) for k in range(3) for c in ("a", "b") for n in range(120)], columns=["k", "c", "n", "p"])
    g = pd.DataFrame([(k, "a", n) for k in range(3) for n in range(120) if rng.random() < 0.1] + [(0, "z", 5)], columns=["k", "c", "t"])
    grid, want, folded = [0.2, 0.5, 0.8], {}, []
    for c in ("a", "b", "z"):
        for h in grid:
            tp = fp = 0
            for k in range(3):
                left, was = sorted(g[(g.k == k) & (g.c == c)].t), None
                for n, p in f[(f.k == k) & (f.c == c)][["n", "p"]].itertuples(index=False):
                    if h <= p and (was is None or h > was):
                        near = min(((abs(n - t), t) for t in left if abs(n - t) <= 2), default=None)
                        tp, fp = tp + (near is not None), fp + (near is None)
                        if near:
                            left.remove(near[1])
                    was = p
            want[c, h] = (tp, fp, int((g.c == c).sum()) - tp)
    plain = E.match_events
    monkeypatch.setattr(E, "match_events", lambda pred, *a: folded.append(pred.count()) or plain(pred, *a))
    rows = matching.sweep(spark.createDataFrame(f), spark.createDataFrame(g), "k", "c", "n", "p", grid, 2, chunk_rows=16).collect()
    got = {(r.c, r.threshold): (r.tp, r.fp, r.fn) for r in rows}
    assert got == want
    assert 0 < folded[0] < sum(tp + fp for tp, fp, _ in want.values()) / 2


def test_weights_and_halo(spark):
    from tendon.operators.windows import window_weights
    rows = [(1, "a")] * 2 + [(1, "b")] * 4 + [(2, "c")] * 4
    w = window_weights(spark.createDataFrame(rows, "session_no int, trial_id string")).toPandas()
    assert w.weight.mean() == pytest.approx(1) and w.groupby("trial_id").weight.sum().to_dict() == pytest.approx({"a": 2.5, "b": 2.5, "c": 5})
    x = RNG.normal(size=100)
    d = spark.createDataFrame(pd.DataFrame({"k": 0, "n": np.arange(100), "x": x}))
    got = S.smooth(d, ["k"], "n", "x", 7, rows=9).orderBy("n").toPandas()["smooth"]
    np.testing.assert_allclose(got, np.convolve(np.pad(x, (3, 3), mode="edge"), np.ones(7) / 7, "valid"))


def test_placement_is_the_best_there_is():
    from itertools import product

    from tendon.operators.templates import best_path
    rng = np.random.default_rng(0)
    for _ in range(400):
        m, n, gap, first = (int(rng.integers(*r)) for r in ((1, 5), (2, 6), (1, 4), (0, 3)))
        cues, scores = sorted(map(int, rng.integers(0, 8, m))), np.round(rng.uniform(-1, 1, (m, n)), 2)
        scores[rng.random((m, n)) < 0.2] = np.nan
        value = scores.copy()
        value[~np.isfinite(scores).any(1), (n - 1) // 2] = -1.0

        def total(path):
            at = [c + d for c, d in zip(cues, path)]
            if any(b < a + gap for a, b in zip(at, at[1:])) or not all(np.isfinite(value[i, d]) for i, d in enumerate(path)):
                return None
            return sum(value[i, d] for i, d in enumerate(path))

        best = max((t for t in map(total, product(range(n), repeat=m)) if t is not None), default=None)
        got = [d - first for d in best_path(cues, scores, first, gap)]
        assert best is None or abs(total(got) - best) < 1e-9


def test_blend_composes_over_many_chunks(spark):
    from tendon.operators.folds import blended
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2, 50 * 40, 2))
    d = spark.createDataFrame([(k, n, n // 40, float(x[k, n, 0]), float(x[k, n, 1])) for k in range(2) for n in range(2000)], "k int, n int, blk int, a double, b double").repartition(7)
    made = blended(d, ["k"], "n", "blk", ["a", "b"], 0.035)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4  # whatever the number of chunks
    got = {(r.k, r.n): (r.a_mean, r.b_mean) for r in made.collect()}
    for k in range(2):
        y = x[k, 0]
        for n in range(2000):
            y = 0.965 * y + 0.035 * x[k, n]
            np.testing.assert_allclose(got[k, n], y, atol=1e-12)
