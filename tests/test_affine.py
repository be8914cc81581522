"""Filters as affine scans against one pass, and state estimates over a table against the row-by-row machine."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tendon.functions import filters as K
from tendon.operators.affine import filtered, transition

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("rows", [1, 37, 10_000])
@pytest.mark.parametrize("sos", [np.concatenate([K.bandpass(4, 20.0, 90.0, 200.0), K.notch(50.0, 30.0, 200.0)]), K.notch(50.0, 5e5, 200.0)], ids=["bandpass", "marginal"])
def test_filter_equals_one_pass(spark, rows, sos):
    x = RNG.normal(size=(900, 2)) + 3.0
    pdf = pd.DataFrame({"k": np.arange(900) % 2, "n": np.arange(900) // 2, "a": x[:, 0], "b": x[:, 1], "note": [f"r{i}" for i in range(900)]})
    d = spark.createDataFrame(pdf).withColumn("c", F.floor(F.col("n") / rows)).repartition(7)
    got = filtered(d, ["k"], "n", "c", ["a", "b"], sos, ["note", "a"], "_f").orderBy("k", "n").toPandas()
    for k in (0, 1):
        own = pdf[pdf["k"] == k]
        want, _ = K.apply(sos, own[["a", "b"]].to_numpy())
        np.testing.assert_allclose(got.loc[got["k"] == k, ["a_f", "b_f"]], want, atol=1e-9, rtol=0)
        assert got.loc[got["k"] == k, "note"].tolist() == own["note"].tolist()


def test_transition_is_what_zeros_do():
    sos = K.bandpass(4, 20.0, 90.0, 200.0)
    _, after = K.apply(sos, RNG.normal(size=(30, 3)))
    _, later = K.apply(sos, np.zeros((25, 3)), after)
    np.testing.assert_allclose(np.linalg.matrix_power(transition(sos), 25) @ after.reshape(-1, 3), later.reshape(-1, 3), atol=1e-12)


def test_estimates_over_a_table_equal_the_machine(spark):
    from tendon.plans.q_j_streams import CH, RUN, tiny_model
    from tendon.streaming.estimator import NAMES, estimates
    x = RNG.normal(scale=40, size=(700, 4))
    x[100:140, 1] = np.nan
    x[300, 2] = np.inf
    pdf = pd.DataFrame({"trial": np.arange(700) % 2, "t": np.arange(700) * 5, **{f"c{i}": x[:, i] for i in range(4)}})
    got = estimates(spark.createDataFrame(pdf).withColumn("b", F.floor(F.col("t") / 600)).repartition(5), ["trial"], "b", tiny_model, CH, CH[:3], emg_scale=50.0, block_rows=64).orderBy("trial", "t").toPandas()
    for k in (0, 1):
        _, want = RUN(None, pdf[pdf["trial"] == k].reset_index(drop=True))
        own = got[got["trial"] == k].reset_index(drop=True)
        assert len(own) == len(want) > 30
        for c in NAMES:
            np.testing.assert_allclose(own[c].astype(float), want[c].astype(float), atol=1e-9)


def test_short_keys_are_chained_without_a_group_each(spark):
    """Entries come from sorted partitions; a Python call for every key took most of the time of the motion track."""
    from tendon.operators.affine import filtered
    from tendon.operators.folds import blended
    rng = np.random.default_rng(4)
    rows = pd.DataFrame([(f"k{k}", n, n // 4, float(rng.normal())) for k in range(40) for n in range(1 + k % 11)], columns=["k", "n", "c", "x"])
    d = spark.createDataFrame(rows)
    mean = blended(d, ["k"], "n", "c", ["x"], 0.25)
    sos = np.array([[0.2, 0.1, 0.0, -0.5, 0.1]])
    smooth = filtered(d, ["k"], "n", "c", ["x"], sos, suffix="_f")
    for f in (mean, smooth):
        assert "FlatMapGroupsInPandas" not in f._jdf.queryExecution().executedPlan().toString()
    got = mean.toPandas().sort_values(["k", "n"]).groupby("k")["x_mean"].apply(list)
    for k, x in rows.groupby("k")["x"]:
        y, want = x.iloc[0], []
        for v in x:
            y = 0.75 * y + 0.25 * v
            want.append(y)
        np.testing.assert_allclose(got[k], want, rtol=1e-12)
    got = smooth.toPandas().sort_values(["k", "n"]).groupby("k")["x_f"].apply(list)
    for k, x in rows.groupby("k")["x"]:
        x, y = [0.0, 0.0, *x], [0.0, 0.0]
        for i in range(2, len(x)):
            y.append(0.2 * x[i] + 0.1 * x[i - 1] + 0.5 * y[-1] - 0.1 * y[-2])
        np.testing.assert_allclose(got[k], y[2:], rtol=1e-9, atol=1e-12)
