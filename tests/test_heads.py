"""Heads, recentred alignment, and answers that had only been seen to run, against plain versions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tendon.functions import filters as K
from tendon.operators import heads, models, templates, transforms
from tendon.operators import signal_jobs as J

RNG = np.random.default_rng(21)


def table(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "id int, x array<double>, y int").repartition(5)


def accuracy(d, head):
    return head.logits(d, "x", "z").withColumn("g", F.array_position("z", F.array_max("z")) - 1).agg(F.avg((F.col("g") == F.col("y")).cast("double"))).first()[0]


def test_moments_and_discriminants_equal_numpy(spark):
    y = RNG.integers(0, 3, 400)
    x = RNG.normal(size=(400, 5)) @ RNG.normal(size=(5, 5)) + 1000.0 + y[:, None] * np.arange(5)
    d = table(spark, x, y)
    means, cov = heads.moments(d, "x", "y")
    got = {r.y: (r.n, np.array(r["mean"])) for r in means.collect()}
    inside = sum((x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in range(3)) / (400 - 3)
    for c in range(3):
        assert got[c][0] == (y == c).sum()
        np.testing.assert_allclose(got[c][1], x[y == c].mean(0), rtol=1e-12)
    c = np.zeros((5, 5))
    for r in cov.collect():
        c[r.i, r.j] = r.value
    np.testing.assert_allclose(c, inside, rtol=1e-9)
    lda = heads.fit_discriminant(d, "x", "y", ridge=0.0)
    mu = np.stack([x[y == k].mean(0) for k in range(3)])
    w = np.linalg.solve(inside, mu.T).T
    np.testing.assert_allclose(lda.weights, w, rtol=1e-6)
    np.testing.assert_allclose(lda.offset, -0.5 * (w * mu).sum(1) + np.log(np.bincount(y) / 400), rtol=1e-6)
    assert accuracy(d, lda) > 0.8
    empty, none = heads.moments(d.limit(0), "x", "y")
    assert empty.count() == 0 and none.count() == 0


def test_kernel_head_splits_a_ring(spark):
    y = RNG.integers(0, 3, 600)
    angle, radius = RNG.uniform(0, 2 * np.pi, 600), 1.0 + y + RNG.normal(scale=0.12, size=600)
    x = np.column_stack([radius * np.cos(angle), radius * np.sin(angle)])
    train, test = table(spark, x[:400], y[:400]), table(spark, x[400:], y[400:])
    kernel = heads.fit_kernel_head(train, "x", "y", lift=heads.Fourier(300, 1.0), iterations=60)
    assert accuracy(test, kernel) > 0.93
    assert accuracy(test, heads.fit_discriminant(train, "x", "y")) < 0.6
    linear = models.fit_head(train, "x", "y", F.lit(1.0))
    d = models.head_logits(test, linear, "x", "z").withColumn("g", F.array_position("z", F.array_max("z")) - 1)
    assert d.agg(F.avg((F.col("g") == F.col("y")).cast("double"))).first()[0] < 0.6
    a, b = (np.stack(heads.Fourier(4000, 0.3).map(test.repartition(n), "x", "f").orderBy("id").toPandas()["f"]) for n in (1, 7))
    np.testing.assert_array_equal(a, b)
    near = np.exp(-0.3 * ((x[400:, None] - x[None, 400:]) ** 2).sum(-1))
    assert np.abs(a @ a.T - near).max() < 0.12


def test_kernel_head_reads_many_small_files_in_few_tasks_and_equals_the_plain_machines(spark, tmp_path):
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.functions import array_to_vector, vector_to_array
    y = RNG.integers(0, 3, 300)
    table(spark, RNG.normal(size=(300, 4)) + y[:, None], y).repartition(20).write.parquet(f"{tmp_path}/files")
    d = spark.read.parquet(f"{tmp_path}/files")
    assert d.rdd.getNumPartitions() > 4
    lift, sc = heads.Fourier(16, 0.2), spark.sparkContext
    sc.setJobGroup("kernel", "fit")
    try:
        head = heads.fit_kernel_head(d, "x", "y", lift=lift, iterations=8)
    finally:
        sc.setJobGroup("other", "")
    told = sc.statusTracker()
    stages = [told.getStageInfo(i) for j in told.getJobIdsForGroup("kernel") for i in told.getJobInfo(j).stageIds]
    most = sorted((i.numTasks for i in stages if i), reverse=True)
    assert len(most) > 20 and sum(n > 4 for n in most) <= 3  # no pass of a machine; only the rows are counted and read so
    v = lift.map(d, "x", "f").select("id", array_to_vector("f").alias("v"), F.col("y").cast("double").alias("label"), F.lit(1.0).alias("w"))
    plain = OneVsRest(classifier=LinearSVC(featuresCol="v", maxIter=8, regParam=1e-4), featuresCol="v", weightCol="w").fit(v)
    for one, other in zip(head.model.models, plain.models, strict=True):
        np.testing.assert_allclose(one.coefficients.toArray(), other.coefficients.toArray(), atol=1e-6)
    got = head.logits(d, "x", "z")
    assert got.columns == [*d.columns, "z"]
    assert got._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1
    want = {r.id: r.z for r in plain.transform(v).select("id", vector_to_array("rawPrediction").alias("z")).collect()}
    for r in got.collect():
        np.testing.assert_allclose(r.z, want[r.id], atol=1e-5)


def test_common_shift_of_a_session_is_taken_out(spark):
    """Two sessions with other delays; within a session the templates cannot tell by how much all events are late, the reference can."""
    shape = {c: RNG.normal(size=(21, 6)) * np.hanning(21)[:, None] for c in "ab"}
    frames, events = [], []
    for s, delay in (("one", 9), ("two", 12)):
        x = RNG.normal(scale=0.01, size=(500, 6)) + 1.0
        for i, cue in enumerate(range(30, 410, 33)):
            x[cue + delay - 10:cue + delay + 11] += shape["ab"[i % 2]]
            events.append((s, i, "ab"[i % 2], cue, delay))
        frames += [(s, i, [float(v) for v in r]) for i, r in enumerate(x)]
    f = spark.createDataFrame(frames, "session string, frame bigint, x array<double>")
    e = spark.createDataFrame(events, "session string, event_id int, class string, cue bigint, planted int")
    ref = spark.createDataFrame([(c, o - 10, [float(v) for v in shape[c][o] - shape[c].mean(0)]) for c in "ab" for o in range(21)], "class string, o int, x array<double>")
    d = templates.align_sessions(f, e, "session", delays=(4, 20), first_delay=10, tolerance=1, reference=ref)
    got = d.join(e.select("session", "event_id", "planted"), ["session", "event_id"]).toPandas()
    assert (got["recentred"] == got["planted"]).mean() > 0.9 and (got["recentred"] - got["planted"]).abs().max() <= 1
    assert got["converged"].all() and set(got.columns) >= {"shift", "delay", "best"}
    own = templates.final_templates(f, d, "session", (-10, 10))
    assert templates.reference_templates(own, "session").select("class").distinct().count() == 2
    assert templates.reference_templates(own, "session", 3).count() == 0


def test_augmentation_repeats_and_keeps_its_ranges(spark):
    d = spark.createDataFrame([(i, [float(v) for v in range(1, 9)]) for i in range(2000)], "id bigint, x array<double>")
    a, b = (transforms.augment(d.repartition(n), "id", "x", seed=7).orderBy("id").toPandas() for n in (1, 6))
    x = np.stack(a["augmented"])
    np.testing.assert_array_equal(x, np.stack(b["augmented"]))
    assert not np.array_equal(x, np.stack(transforms.augment(d, "id", "x", seed=8).orderBy("id").toPandas()["augmented"]))
    gone = (x == 0.0).sum(axis=1)
    assert gone.max() == 1 and 0.2 < gone.mean() < 0.3
    whole = x[gone == 0]
    turn = (whole.argmin(axis=1)) % 8
    plain = np.stack([np.roll(r, -t) for r, t in zip(whole, turn, strict=True)])
    assert len(set(turn)) == 8
    gain = np.median(plain / np.arange(1, 9), axis=1)
    assert 0.79 < gain.min() < 0.82 and 1.18 < gain.max() < 1.21
    assert np.abs(plain - gain[:, None] * np.arange(1, 9)).max() < 0.03


def test_fixed_lag_equals_the_chain(spark):
    x = RNG.normal(size=(300, 2)).cumsum(axis=0)
    d = spark.createDataFrame(pd.DataFrame({"k": 0, "n": np.arange(300), "a": x[:, 0], "b": x[:, 1]})).repartition(4)
    got = J.fixed_lag(d, ["k"], "n", ("a", "b"), 250.0, 16.0, buffer=100, window=50, lag=10, hop=50).orderBy("j").toPandas()
    assert got["last_n"].tolist() == [89, 139, 189, 239, 289]
    for i, r in got.iterrows():
        part = x[50 * i:50 * i + 100]
        want = K.training_chain(part - np.median(part, axis=0), 250.0)[40:90] / 16.0
        np.testing.assert_allclose(np.column_stack([r["a"], r["b"]]), want, atol=1e-9)


def test_scores_equal_plain_numbers(spark):
    z = RNG.normal(size=(60, 4))
    d = spark.createDataFrame([(i, [float(v) for v in r], i % 2) for i, r in enumerate(z)], "id int, z array<double>, session_no int")
    bias = spark.createDataFrame([(1, [0.3, -0.1, 0.0, -0.2])], "session_no int, bias array<double>")
    got = models.score(d, "z", "z", None, 0.5, 0.6, 1.0, bias).orderBy("id").toPandas()
    y = z / 0.5
    y[1::2] += np.array([0.3, -0.1, 0.0, -0.2])
    p = np.exp(y - y.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    top = np.sort(p, axis=1)
    np.testing.assert_allclose(got["q"], top[:, -1], atol=1e-12)
    np.testing.assert_allclose(got["margin"], top[:, -1] - top[:, -2], atol=1e-12)
    assert got["raw"].tolist() == p.argmax(1).tolist()
    assert got["pred"].tolist() == [int(c) if q >= 0.6 else -1 for c, q in zip(p.argmax(1), top[:, -1])]


def test_replay_in_blocks_equals_one_pass(spark):
    from tendon.operators import events as E
    from tendon.plans.q_h_alignment import CH, replay_frames, rms_model
    root = "/root/testdata/sf0.001"
    from tendon.plans.q_g_signal import long_trials
    pdf = long_trials(spark, root).toPandas().sort_values(["trial", "n"])
    want = pd.concat([rms_model(g["n"].to_numpy(), g[list(CH)].to_numpy()).assign(trial=t) for t, g in pdf.groupby("trial")]).sort_values(["trial", "n"])
    out = {}
    for rows in (16, 16_000):
        f = replay_frames(spark, root, rows)
        got = f.groupBy("trial", "n").pivot("o", [0, 1, 2, 3]).agg(F.first("p")).orderBy("trial", "n").toPandas()
        np.testing.assert_array_equal(got[["trial", "n"]], want[["trial", "n"]])
        np.testing.assert_allclose(got[["0", "1", "2", "3"]], want[["p0", "p1", "p2", "p3"]], atol=1e-8)
        ev = E.threshold_events(f.withColumn("slot", F.floor(F.col("n") / 65_536)), ["trial"], "n", "cls", "p", F.lit(0.5), 12, levels=[["slot"]], order_of=F.col("o"))
        out[rows] = sorted(map(tuple, ev.collect()))
    assert out[16] == out[16_000] and out[16]


def test_review_envelope_equals_a_plain_one(spark):
    x = RNG.normal(size=(3, 64, 2))
    rows = [(s, i, float(a), float(b)) for s in range(3) for i, (a, b) in enumerate(x[s])]
    d = spark.createDataFrame(rows, "s int, o int, a double, b double").repartition(4)
    got = J.review_envelope(d, ["s"], "o", ("a", "b"), 200.0).orderBy("s", "o").toPandas()
    for s in range(3):
        spec = np.fft.rfft(x[s] - np.median(x[s], axis=0), axis=0)
        for k, f in enumerate(np.fft.rfftfreq(64, 1 / 200.0)):
            if f < 20 or f > 99 or any(abs(f - m) <= 3 for m in (50, 100)):
                spec[k] = 0
        power = (np.fft.irfft(spec, n=64, axis=0) ** 2).mean(axis=1)
        w = 5  # 25 ms at 200 Hz
        want = [np.sqrt(max(np.mean([power[min(63, max(0, i + j))] for j in range(-(w // 2), w - w // 2)]), 0)) for i in range(64)]
        np.testing.assert_allclose(got.loc[got["s"] == s, "activity"], want, atol=1e-9)
