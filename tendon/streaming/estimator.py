"""State estimate per device: filter, window, quality, score, phases, lag.

A stream runs them row by row in `estimator`, whose state lies in the state store. Over a table `estimates` gives the same rows as DataFrame jobs: the
filter is an affine scan, windows come from blocks with a halo, phases and onsets follow from the windows; only the model and what it reads is Python.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters as K
from ..operators import events, steps
from ..operators.affine import filtered
from ..operators.ordered import number_rows, running, scan
from ..operators.signal_jobs import overlap_map
from ..operators.transforms import finite
from ..runtime import cut

SCHEMA = "t bigint, direction int, gesture int, arm_phase int, hand_phase int, lag bigint, activation double, motion double, emg_quality double, imu_quality double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _quality(emg, imu, size):
    """Of stacked windows: share of finite values that also move, and of axes that are finite throughout."""
    fin_e, fin_i = np.isfinite(emg), np.isfinite(imu)
    moving = np.nan_to_num(emg).std(axis=1) > 1e-10
    share = min(1.0, emg.shape[1] / size)
    return (fin_e.mean(axis=1) * moving).mean(axis=1) * share, (fin_i.mean(axis=1) * fin_i.all(axis=1)).mean(axis=1) * share


def unit(v) -> np.ndarray:
    """Within [0, 1]; what is no number is 0."""
    return np.where(v > 0.0, np.minimum(v, 1.0), 0.0)


def score_windows(model, rows, ends, raw, clean, imu, size, minimum_quality, emg_scale, most=1024) -> list[tuple]:
    """(direction, gesture, activation, motion, EMG quality, IMU quality) of the windows of `size` rows that end at the row numbers `ends`; a head without quality is unknown.

    `raw`, `clean` and `imu` name columns of `rows`. Up to `most` windows are worked on together; only the model sees them one by one.
    """
    made = []
    for at in range(0, len(ends), most):
        w = rows[(np.asarray(ends[at:at + most]) + (1 - size))[:, None] + np.arange(size)]
        fe, fi = w[:, :, clean] / emg_scale, np.nan_to_num(w[:, :, imu], nan=0.0, posinf=0.0, neginf=0.0)
        qe, qi = _quality(w[:, :, raw], w[:, :, imu], size)
        heads = [model(e, i) for e, i in zip(fe, fi)]
        columns = (unit(np.median(np.sqrt((fe ** 2).mean(axis=1)), axis=1)), unit(np.sqrt((fi ** 2).sum(axis=2).mean(axis=1))), unit(qe), unit(qi))
        made += [(d if i >= minimum_quality else -1, g if e >= minimum_quality else -1, *x)
                 for (d, _, g, _), e, i, *x in zip(heads, qe.tolist(), qi.tolist(), *[c.tolist() for c in columns], strict=True)]
    return made


def estimator(model, emg_columns, imu_columns, rate=200.0, size=40, hop=8, low=20.0, high=90.0, minimum_quality=0.5, lag_limit=600, emg_scale=1.0):
    """`model(emg window, imu window) -> (direction, q, gesture, q)`. Rows: t (must grow) and the channels."""
    sos = K.bandpass(4, low, high, float(rate))
    arm, hand = steps.phase_tracker(), steps.phase_tracker()
    emg_columns, imu_columns = list(emg_columns), list(imu_columns)

    def run(state, pdf):
        s = state or {"zi": None, "last": -1, "buf": [], "since": 0, "arm": [0, 0, 0, 0], "hand": [0, 0, 0, 0], "onset": [None, None]}
        t = pdf["t"].to_numpy()
        keep = t > np.maximum.accumulate(np.concatenate([[s["last"]], t[:-1]]))
        pdf, t = pdf[keep], t[keep]
        emg, imu = pdf[emg_columns].to_numpy(dtype=float), pdf[imu_columns].to_numpy(dtype=float)
        out = []
        if len(t):
            clean, zi = K.apply(sos, np.nan_to_num(emg, nan=0.0, posinf=0.0, neginf=0.0), s["zi"])
            old = np.array(s["buf"], dtype=float).reshape(-1, 2 * emg.shape[1] + imu.shape[1])
            rows = np.vstack([old, np.hstack([emg, clean, imu])])
            c, before = emg.shape[1], len(old)
            ends = np.arange(max(hop - s["since"], size - before, 1) - 1, len(t), hop)  # a window ends `hop` rows after the last one, once there are `size` rows
            since = int(len(t) - 1 - ends[-1]) if len(ends) else s["since"] + len(t)
            scores = score_windows(model, rows, before + ends, slice(0, c), slice(c, 2 * c), slice(2 * c, None), size, minimum_quality, emg_scale)
            for i, (d, g, act, mov, qe, qi) in zip(ends.tolist(), scores, strict=True):
                s["arm"], [(_, ds, dp)] = arm(s["arm"], {"n": 0, "label": d})
                s["hand"], [(_, gs, gp)] = hand(s["hand"], {"n": 0, "label": g})
                on = s["onset"]
                on[0] = int(t[i]) if dp == steps.ONSET else on[0]
                on[1] = int(t[i]) if gp == steps.ONSET else on[1]
                gap = None if None in on else on[1] - on[0]
                gap = gap if gap is not None and abs(gap) <= lag_limit else None
                out.append((int(t[i]), ds, gs, dp, gp, gap, act, mov, qe, qi))
            s.update(zi=zi.tolist(), last=int(t[-1]), since=since, buf=np.where(np.isfinite(tail := rows[-(size - 1):]), tail, None).tolist())
        return s, pd.DataFrame(out, columns=NAMES)

    return run


def estimates(df: DataFrame, keys, chunk: str, model, emg_columns, imu_columns, rate=200.0, size=40, hop=8, low=20.0, high=90.0, minimum_quality=0.5, lag_limit=600, emg_scale=1.0,
              block_rows=65_536) -> DataFrame:
    """The rows that `estimator` would give over each key of a table. Reads t and the channels; `chunk` follows t. Windows end at row `size` and every `hop` rows after it."""
    keys, emg, imu = list(keys), list(emg_columns), list(imu_columns)
    channels = list(dict.fromkeys([*emg, *imu]))
    d = scan(df.select(*keys, chunk, "t", *channels), keys, ["t"], {"__t": running("lag", "t")}, [[chunk]]).where(F.col("t") > F.coalesce("__t", F.lit(-1)))
    d = number_rows(d.drop("__t"), keys, ["t"], "n", [[chunk]]).withColumn("blk", F.floor(F.col("n") / block_rows))
    d = d.select(*keys, "blk", "n", F.col("t").cast("double").alias("t"), *[F.col(c).cast("double").alias(c) for c in channels], *[F.when(finite(F.col(c)), F.col(c)).otherwise(0.0).cast("double").alias(f"{c}_in") for c in emg])
    d = filtered(d, keys, "n", "blk", [f"{c}_in" for c in emg], K.bandpass(4, low, high, float(rate)), ["t", *channels], "_clean")
    columns = ["t", *channels, *[f"{c}_in_clean" for c in emg]]
    raw, seen = [1 + channels.index(c) for c in emg], [1 + channels.index(c) for c in imu]
    clean = slice(1 + len(channels), None)

    def windows(n, x):
        ends = np.flatnonzero((n >= size - 1) & ((n - (size - 1)) % hop == 0))
        ends = ends[ends + 1 >= size]
        scores = score_windows(model, x, ends, raw, clean, seen, size, minimum_quality, emg_scale)
        made = [(int(n[i]), int(x[i, 0]), *row) for i, row in zip(ends, scores, strict=True)]
        return pd.DataFrame(made, columns=["n", "t", "d", "g", "activation", "motion", "emg_quality", "imu_quality"]).astype({c: "int64" for c in ("n", "t", "d", "g")})

    w = cut(overlap_map(d, keys, "n", columns, block_rows, size - 1, 0, windows, "n bigint, t bigint, d bigint, g bigint, activation double, motion double, emg_quality double, imu_quality double"))
    w = w.withColumn("slot", F.floor(F.col("n") / block_rows))
    for name, label in (("arm", "d"), ("hand", "g")):
        p = events.phases(w.select(*keys, "slot", "n", F.col(label).alias("label")), keys, "slot")
        w = w.join(p.select(*keys, "n", F.col("stable").alias(f"{name}_label"), F.col("phase").alias(f"{name}_phase")), [*keys, "n"])
    onset = {f"{name}_at": running("last", F.when(F.col(f"{name}_phase") == steps.ONSET, F.col("t"))) for name in ("arm", "hand")}
    w = scan(w, keys, ["n"], onset, [["slot"]]).withColumn("lag", F.col("hand_at") - F.col("arm_at"))
    return w.select(*keys, "t", F.col("arm_label").cast("int").alias("direction"), F.col("hand_label").cast("int").alias("gesture"), F.col("arm_phase").cast("int").alias("arm_phase"),
                    F.col("hand_phase").cast("int").alias("hand_phase"), F.when(F.abs("lag") <= lag_limit, F.col("lag")).alias("lag"), "activation", "motion", "emg_quality", "imu_quality")
