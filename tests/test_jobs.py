"""Signal, template, matching and model jobs against small known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tendon.functions import filters as K
from tendon.operators import calibration, matching, models, onset, templates
from tendon.operators import events as E
from tendon.operators import signal_jobs as J
from tendon.streaming import stateful as Z

RNG = np.random.default_rng(9)


def tone(spark, n, rate, *hz):
    t = np.arange(n) / rate
    return spark.createDataFrame(pd.DataFrame({"k": 0, "n": np.arange(n), **{f"c{i}": np.sin(2 * np.pi * f * t) for i, f in enumerate(hz)}}))


def test_bandpass_keeps_35_rejects_5_and_chunks_agree(spark):
    d = tone(spark, 1200, 200.0, 5.0, 35.0)
    out = {}
    for size in (100, 10 ** 6):
        r = J.causal_filter(d.withColumn("b", F.floor(F.col("n") / size)), ["k"], "n", "b", ["c0", "c1"], 200.0).orderBy("n").toPandas()
        out[size] = r[["c0", "c1"]].to_numpy()
    rms = np.sqrt((out[100][400:] ** 2).mean(axis=0))
    assert rms[0] < 0.02 and rms[1] > 0.65
    np.testing.assert_allclose(out[100], out[10 ** 6], atol=1e-9)


def test_block_filter_equals_plain_recursion():
    sos = K.bandpass(4, 20.0, 90.0, 200.0)
    x = RNG.normal(size=(150, 2))
    y, z = x.copy(), None
    for b0, b1, b2, a1, a2 in sos:
        out, s1, s2 = np.empty_like(y), np.zeros(2), np.zeros(2)
        for i, v in enumerate(y):
            out[i] = b0 * v + s1
            s1, s2 = b1 * v - a1 * out[i] + s2, b2 * v - a2 * out[i]
        y = out
    np.testing.assert_allclose(K.apply(sos, x)[0], y, atol=1e-12)


def test_zero_phase_rejects_mains_and_chunks_agree(spark):
    d = tone(spark, 6000, 500.0, 50.0, 80.0)
    whole = J.zero_phase(d, ["k"], "n", ["c0", "c1"], 500.0, rows=10 ** 6).orderBy("n").toPandas()
    parts = J.zero_phase(d, ["k"], "n", ["c0", "c1"], 500.0, rows=2500).orderBy("n").toPandas()
    assert whole["c0"][2000:4000].std() < 0.02 and whole["c1"][2000:4000].std() > 0.6
    np.testing.assert_allclose(whole[["c0", "c1"]], parts[["c0", "c1"]], atol=1e-6)


def test_resample_length_and_tone(spark):
    r = J.resample(tone(spark, 1000, 250.0, 10.0), ["k"], "n", "c0", 250.0, 200.0).orderBy("i").toPandas()
    assert len(r) == 800
    np.testing.assert_allclose(r["y"][50:750], np.sin(2 * np.pi * 10 * np.arange(800) / 200)[50:750], atol=5e-3)
    with pytest.raises(ValueError):
        J.resample(tone(spark, 10, 100.0, 1.0), ["k"], "n", "c0", 100.0, 200.0)


def test_spectral_features_shape_rotation_and_chunks(spark):
    x = RNG.normal(size=(300, 8))
    make = lambda a: spark.createDataFrame(pd.DataFrame({"k": 0, "n": np.arange(300), **{f"c{i}": a[:, i] for i in range(8)}}))
    ch = [f"c{i}" for i in range(8)]
    get = lambda a, f: np.stack(J.spectral_features(make(a), ["k"], "n", ch, frames_per_block=f).orderBy("frame").toPandas()["features"])
    whole = get(x, 4096)
    assert whole.shape == ((300 - J.SpectralSetup().context - 1) // 4 + 1, 192)
    np.testing.assert_allclose(whole, get(x, 7), atol=1e-9)
    turned = get(np.roll(x, 1, axis=1), 4096).reshape(len(whole), 6, 4, 8)
    np.testing.assert_allclose(np.roll(whole.reshape(len(whole), 6, 4, 8), 1, axis=3), turned, atol=1e-6)


def full_confusion(pred, truth, tol=(-0.05, 0.25)):
    """One alignment over the whole sequence, path order included."""
    def path(left, right):
        cost = {(0, 0): (0, 0.0, 0)}
        for i in range(len(left) + 1):
            for j in range(len(right) + 1):
                if (i, j) == (0, 0):
                    continue
                o = []
                if i:
                    o.append((cost[i - 1, j][0] + 1, cost[i - 1, j][1], 1))
                if j:
                    o.append((cost[i, j - 1][0] + 1, cost[i, j - 1][1], 2))
                if i and j and not (left[i - 1][3] < right[j - 1][2] or right[j - 1][3] < left[i - 1][2]):
                    o.append((cost[i - 1, j - 1][0] + (left[i - 1][0] != right[j - 1][0]), cost[i - 1, j - 1][1] + abs(left[i - 1][1] - right[j - 1][1]), 3))
                cost[i, j] = min(o, key=lambda z: z[:2])
        i, j, out = len(left), len(right), []
        while i or j:
            m = cost[i, j][2]
            out.append((i - 1 if m != 2 else None, j - 1 if m != 1 else None))
            i, j = i - (m != 2), j - (m != 1)
        return out[::-1]
    p = [(n, t, t, t) for n, t in pred]
    g = [(n, t, t + tol[0], t + tol[1]) for n, t in truth]
    state, keep = "NEUTRAL", []
    for a, b in path(p, g):
        if a is not None and p[a][0] not in matching.BARRED[state]:
            keep.append(p[a])
        if b is not None:
            state = matching.STATE_AFTER.get(g[b][0], "NEUTRAL")
    return [(g[a][0], keep[b][0] if b is not None else None) for a, b in path(g, keep) if a is not None]


def test_alignment_equals_one_alignment_of_everything(spark):
    names = ["index_press", "index_release", "middle_press", "middle_release", "thumb_up"]
    p_rows, g_rows, want = [], [], []
    for k in range(6):
        g = [(str(RNG.choice(names)), float(t)) for t in np.cumsum(RNG.uniform(0.05, 0.9, 25)).round(4)]
        p = sorted([(n if RNG.random() < 0.7 else str(RNG.choice(names)), round(t + float(RNG.uniform(-0.04, 0.3)), 4)) for n, t in g if RNG.random() < 0.8]
                   + [(str(RNG.choice(names)), round(float(t), 4)) for t in RNG.uniform(0, 12, 5)], key=lambda e: (e[1], e[0]))
        g_rows += [(k, *e) for e in g]
        p_rows += [(k, *e) for e in p]
        want += [(k, *e) for e in full_confusion(p, g)]
    c = matching.confusion(spark.createDataFrame(p_rows, "k int, name string, t double"), spark.createDataFrame(g_rows, "k int, name string, t double"), "k", slot_seconds=2.0)
    got = [(r.k, r.truth, r.pred) for r in c.collect() for _ in range(r.n)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_mean_fnr_known_answer(spark):
    c = matching.confusion(spark.createDataFrame([(0, "thumb_click", 1.0)], "k int, name string, t double"),
                           spark.createDataFrame([(0, "thumb_click", 1.0), (0, "thumb_down", 3.0)], "k int, name string, t double"), "k")
    assert matching.mean_fnr(c).first()[0] == pytest.approx(0.5)
    assert matching.cler(c).first()[0] == pytest.approx(0.0)


def session_frames(spark, delay=7, n=500, width=6):
    """Two classes of responses, overlapping, on a noisy background."""
    x = RNG.normal(scale=0.01, size=(n, width)) + 1.0
    shape = {c: RNG.normal(size=(21, width)) * np.hanning(21)[:, None] for c in ("a", "b")}
    events = []
    for i, cue in enumerate(range(30, n - 90, 33)):
        c = "ab"[i % 2]
        events.append(("s", i, c, cue))
        x[cue + delay - 10:cue + delay + 11] += shape[c]
    frames = spark.createDataFrame([("s", i, list(map(float, r))) for i, r in enumerate(x)], "session string, frame bigint, x array<double>")
    return frames, spark.createDataFrame(events, "session string, event_id int, class string, cue bigint"), shape


def test_templates_recovered(spark):
    frames, ev, shape = session_frames(spark)
    t = templates.fit_templates(frames, ev.withColumn("center", F.col("cue") + 7), "session", (-10, 10)).toPandas()
    for c in "ab":
        got = np.stack(t[t["class"] == c].sort_values("o")["tpl"])
        assert np.corrcoef(got.ravel(), shape[c].ravel())[0, 1] > 0.99


def test_delays_recovered(spark):
    frames, ev, _ = session_frames(spark, delay=9)
    d = templates.align_sessions(frames, ev, "session", delays=(4, 20), first_delay=8).toPandas()
    assert (d["delay"] - d["delay"].median()).abs().max() <= 1 and d["best"].min() > 0.9


def test_bias_bounds_and_large_session_path(spark, monkeypatch):
    rows = [(int(i % 2), [float(v) for v in RNG.normal(size=3)], int(i % 3)) for i in range(60)]
    d = spark.createDataFrame(rows, "s int, z array<double>, y int")
    one = models.fit_bias(d, "s", "z", "y", 3).orderBy("s").toPandas()
    b = np.stack(one["bias"])
    assert np.abs(b).max() <= models.MAX_BIAS
    monkeypatch.setattr(models, "SESSION_ROWS", 10)
    monkeypatch.setattr(models, "STEPS", 4)
    big = np.stack(models.fit_bias(d, "s", "z", "y", 3).orderBy("s").toPandas()["bias"])
    monkeypatch.setattr(models, "SESSION_ROWS", 1000)
    np.testing.assert_allclose(big, np.stack(models.fit_bias(d, "s", "z", "y", 3).orderBy("s").toPandas()["bias"]), atol=1e-9)


def test_rotation_is_orthogonal(spark):
    q, _ = np.linalg.qr(RNG.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    rows = [(1, d, *map(float, 3.0 * np.array(v) @ q)) for d, v in calibration.BODY_VECTORS.items()]
    r = calibration.fit_rotation(spark.createDataFrame(rows, "s int, d int, x double, y double, z double"), "s", "d").first()
    m = np.array(r["rotation"])
    np.testing.assert_allclose(m @ m.T, np.eye(3), atol=1e-9)
    np.testing.assert_allclose(m, q, atol=1e-9)
    assert np.linalg.det(m) == pytest.approx(1) and r["residual"] < 1e-9


def test_edit_split_sums_to_levenshtein(spark):
    words = ["".join(RNG.choice(list("abcd"), RNG.integers(1, 12))) for _ in range(40)]
    d = spark.createDataFrame(list(zip(words, words[1:] + words[:1])), "a string, b string").select(
        "a", "b", matching.edit_split("a", "b").alias("e"), F.levenshtein("a", "b").alias("l")).toPandas()
    for r in d.itertuples():
        assert r.e["insertions"] + r.e["deletions"] + r.e["replacements"] == r.l and r.e["insertions"] - r.e["deletions"] == len(r.b) - len(r.a)


def test_edit_split_of_many_lengths(spark):
    """Every pair of a batch as by the plain table; nulls give nulls. Before, a null text ended the job."""
    def plain(a, b):
        row = [(j, j) for j in range(len(b) + 1)]
        for i, c in enumerate(a, 1):
            new = [(i, i)]
            for j, d in enumerate(b, 1):
                new.append(min((row[j][0] + 1, row[j][1] + 1), (new[-1][0] + 1, new[-1][1] + 1), (row[j - 1][0] + (c != d), row[j - 1][1])))
            row = new
        return row[-1]
    texts = ["", "a", "\U0001F600b", "abcabcabd" * 9, *("".join(RNG.choice(list("abc"), RNG.integers(0, 70))) for _ in range(30))]
    pairs = [(a, b) for a in texts for b in texts[::3]]
    rows = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string").coalesce(1).select("a", "b", matching.edit_split("a", "b").alias("e")).collect()
    assert len(rows) == len(pairs) + 2
    for r in rows:
        if r.a is None or r.b is None:
            assert tuple(r.e) == (None, None, None)
            continue
        edits, gaps = plain(r.a, r.b)
        ins = (gaps + len(r.b) - len(r.a)) // 2
        assert tuple(r.e) == (ins, gaps - ins, edits - gaps)


def test_activity_detects_a_burst(spark):
    x = np.full(400, 0.1)
    x[::2] += 0.01
    x[200:260] = 5.0
    d = spark.createDataFrame(pd.DataFrame({"k": 0, "n": np.arange(400), "t": np.arange(400) * 5, "e": x * x, "c": np.arange(400) // 50}))
    r = E.activity(d, ["k"], "n", "t", "e", "c", baseline_rows=100, window=8, onset_rows=4, quiet_rows=30, refractory_rows=20).collect()
    assert len(r) == 1 and abs(r[0].onset - 1000) <= 10 and 1300 <= r[0].offset <= 1350 and r[0].peak > 4


def test_cue_onset_finds_the_rise(spark):
    rate, n = 100.0, 600
    x = RNG.normal(scale=0.1, size=n)
    x[330:420] += 8 * np.sin(np.arange(90) * 2.5)
    d = spark.createDataFrame(pd.DataFrame({"k": 0, "n": np.arange(n), "c0": x, "c1": x[::-1].copy() * 0}))
    env = onset.energy_envelope(d, ["k"], "n", ["c0", "c1"], rate)
    cue = spark.createDataFrame([(0, 1, 300, "index_press")], "k bigint, id int, cue bigint, name string")
    r = onset.cue_onsets(env, cue, ["k"], "n", "id", "cue", "name", rate, ("index_release",)).first()
    assert abs(r.onset - 330) <= 3 and r.method == "energy_rise_v1" and r.confidence > 0.9


def test_stream_equals_batch(spark):
    from tendon.operators.folds import chunked_fold
    from tendon.plans.q_j_streams import RUN, SCHEMA
    x = RNG.normal(scale=40, size=(500, 4))
    d = spark.createDataFrame(pd.DataFrame({"trial": np.arange(500) % 2, "t": np.arange(500) * 5, "blk": np.arange(500) // 120, **{f"c{i}": x[:, i] for i in range(4)}}))
    batch = sorted(map(tuple, chunked_fold(d, ["trial"], ["t"], "blk", RUN, None, SCHEMA).collect()))
    r = Z.Replay(spark, d.repartition(12), "dev", "t", slices=3, files=1)  # at least six micro-batches, rows of every file mixed inside a slice
    live = sorted(map(tuple, Z.to_table(Z.stateful(r.stream, ["trial"], ["t"], RUN, None, SCHEMA), "x", r).collect()))
    assert [r[:7] for r in live] == [r[:7] for r in batch]
    np.testing.assert_allclose([r[7:] for r in live], [r[7:] for r in batch], atol=1e-9)


def test_test_split_is_read_once(spark):
    from tendon.operators.evaluation import evaluate_once
    from tendon.runtime import scratch
    d = spark.createDataFrame([(0, 0, 1, 1, 0.9), (1, -1, 0, 0, 0.2)], "truth int, pred int, truth2 int, pred2 int, q double")
    path = scratch(spark, "eval")
    assert evaluate_once(d, F.lit(1.0), path).count() == 1
    with pytest.raises(Exception):
        evaluate_once(d, F.lit(1.0), path)


def test_missing_fields_are_named(spark):
    from tendon.runtime import scratch
    from tendon.sources.tables import read_samples
    path = scratch(spark, "bad")
    spark.createDataFrame([("s", "t")], "session_id string, trial_id string").write.parquet(path)
    with pytest.raises(ValueError, match="accel, direction, emg"):
        read_samples(spark, path)


def test_shuffled_files_one_per_batch_change_nothing(spark):
    """The whole table out of order, a file per micro-batch: rows wait for the watermark."""
    from tendon.runtime import scratch
    rng = np.random.default_rng(4)
    rows = [(int(k), int(t), str(rng.choice(["index_press", "index_release", "thumb_up"]))) for k in range(3) for t in rng.choice(5000, 60, replace=False)]
    d = spark.createDataFrame(rows, "k int, t bigint, name string")
    want, kept = [], {}
    from tendon.operators import steps
    step = steps.debounce(70)
    for k, t, name in sorted(rows):
        kept[k], out = step(kept.get(k), {"name": name, "t": t})
        want += [(k, *o) for o in out]
    path = scratch(spark, "shuffled")
    rng.shuffle(rows)
    for i in range(5):
        spark.createDataFrame(rows[i::5], d.schema).coalesce(1).write.mode("append").parquet(path)
    s = Z.timed(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(path), "t", 6000, shift=1000)
    out = scratch(spark, "out")
    q = Z.debounced(s, ["k"], 70).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "ck")).start()
    q.processAllAvailable()
    for t in (10**6, 2 * 10**6):
        spark.createDataFrame([(None, t, None)], d.schema).coalesce(1).write.mode("append").parquet(path)
        q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.read.parquet(out).select("k", "t", "name").collect())) == sorted(want)
