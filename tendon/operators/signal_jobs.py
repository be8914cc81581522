"""Signal transforms as Spark jobs: chunks with carried state or with overlap."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters as K
from .affine import filtered
from .folds import grouped_rows
from .ordered import exact_quantiles
from .joins import small
from .sequences import halo
from .windows import hop_windows


def causal_filter(df: DataFrame, keys, n: str, chunk: str, channels, rate: float, low=20.0, high=90.0, use_notch=False) -> DataFrame:
    """Band-pass (order 4) and optional 50 Hz notch; the filter state is carried from chunk to chunk as an affine map."""
    sos = K.bandpass(4, low, high, float(rate))
    if use_notch:
        sos = np.concatenate([sos, K.notch(50.0, 30.0, float(rate))])
    return filtered(df, keys, n, chunk, channels, sos)


def overlap_map(df: DataFrame, keys, n: str, channels, rows: int, before: int, after: int, fn, schema: str) -> DataFrame:
    """fn(ordered n, values) -> frame per block that carries `before`/`after` extra rows; block size is bounded.

    fn returns a frame with a column `n`; rows outside the block's own range are dropped.
    """
    keys, channels = list(keys), list(channels)
    h = halo(df.select(*keys, n, *channels), n, rows, before, after)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(n, kind="stable")
        b = int(pdf["hblk"].iloc[0])
        out = fn(pdf[n].to_numpy(), pdf[channels].to_numpy(dtype=float))
        out = out[(out["n"] >= b * rows) & (out["n"] < (b + 1) * rows)].reset_index(drop=True)
        for i, c in enumerate(keys):
            out.insert(i, c, pdf[c].iloc[0])
        return out

    return h.groupBy(*keys, "hblk").applyInPandas(block, f"{kinds}, {schema}")


def zero_phase(df: DataFrame, keys, n: str, channels, rate: float, rows=131_072, settle_seconds=4.0) -> DataFrame:
    """Training chain (median removed, high-pass, mains comb) in overlapping blocks.

    The slowest part is a notch with Q 30 at 50 Hz, time constant about 0.19 s;
    four seconds on both sides leave less than 1e-9 of a block edge.
    """
    channels = list(channels)
    long = df.select(*keys, F.posexplode(F.array(*channels)).alias("ch", "x"))
    med = exact_quantiles(long, [*keys, "ch"], "x", {"m": 0.5})
    wide = med.groupBy(*keys).agg(*[F.max(F.when(F.col("ch") == i, F.col("m"))).alias(f"m_{c}") for i, c in enumerate(channels)])
    d = df.join(small(wide), list(keys)).select(*keys, n, *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in channels])
    edge = int(settle_seconds * rate)

    def fn(pos, x):
        y = K.training_chain(x, rate) if len(x) > 1 else x
        return pd.DataFrame({"n": pos, **{c: y[:, i] for i, c in enumerate(channels)}})

    return overlap_map(d, keys, n, channels, rows, edge, edge, fn, "n bigint, " + ", ".join(f"{c} double" for c in channels))


def resample(df: DataFrame, keys, n: str, value: str, src: float, dst: float, name="y") -> DataFrame:
    """Rational resampling: every source row meets the few outputs under its filter, then a sum.

    Never used upwards for electrode signals. An output exists when its own
    source position exists, which every group can tell from its rows.
    """
    r = Fraction(dst / src).limit_denominator(10_000)
    up, down = r.numerator, r.denominator
    if up > down:
        raise ValueError("electrode signals are not resampled upwards")
    taps, half = K.resample_taps(up, down)
    h = F.array(*[F.lit(float(t)) for t in taps])
    lo = F.greatest(F.lit(0), F.ceil((F.col(n) * up - half) / F.lit(down)))
    hi = F.floor((F.col(n) * up + half) / F.lit(down))
    d = df.select(*keys, n, value, F.explode(F.sequence(lo.cast("bigint"), hi)).alias("__i"))
    tap = F.get(h, (F.col("__i") * down - F.col(n) * up + half).cast("int"))
    g = d.groupBy(*keys, "__i").agg(F.sum(F.col(value) * tap).alias(name), F.max(n).alias("__top"))
    return g.where(F.col("__top") >= F.floor(F.col("__i") * down / F.lit(up))).withColumnRenamed("__i", "i").drop("__top")


@dataclass(frozen=True)
class SpectralSetup:
    """The 200 Hz preset."""

    rate: int = 200
    window: int = 20
    stride: int = 4
    fft: int = 16
    fft_stride: int = 1
    bands: tuple = ((0.0, 12.5), (12.5, 25.0), (25.0, 37.5), (37.5, 50.0), (50.0, 75.0), (75.0, 100.0))
    diagonals: int = 4
    floor: float = 1e-6
    nan_to_zero: bool = False

    @property
    def context(self) -> int:
        return self.window - self.fft_stride + self.fft - 1


# fixed values: the 2000 Hz preset
FAST = SpectralSetup(2000, 200, 40, 64, 10, ((0.0, 62.5), (62.5, 125.0), (125.0, 250.0), (250.0, 375.0), (375.0, 687.5), (687.5, 1000.0)))


def spectral_rows(x, s: SpectralSetup):
    """Matrix-log cross-spectral features of one block (samples x channels): frames x features."""
    taper = np.hanning(s.fft)
    starts = np.arange(0, len(x) - s.fft + 1, s.fft_stride)
    seg = x[starts[:, None] + np.arange(s.fft)[None, :]] * taper[None, :, None]
    spec = np.fft.rfft(seg, axis=1) / np.linalg.norm(taper)
    depth, hop = s.window // s.fft_stride, s.stride // s.fft_stride
    frames = (len(spec) - depth) // hop + 1
    freq = np.abs(np.fft.fftfreq(s.fft, 1.0 / s.rate))[:spec.shape[1]]
    c = np.arange(x.shape[1])
    out = []
    for first in range(0, frames, 128):
        at = (np.arange(first, min(first + 128, frames)) * hop)[:, None] + np.arange(depth)[None, :]
        z = spec[at].transpose(0, 2, 3, 1)
        power = np.abs(z @ z.conj().swapaxes(-1, -2) / depth) ** 2
        bands = np.stack([power[:, (freq > low) & (freq <= high)].mean(axis=1) for low, high in s.bands], axis=1)
        ev, vec = np.linalg.eigh(bands)
        with np.errstate(all="ignore"):
            lg = np.nan_to_num(np.log(ev), nan=0.0, neginf=0.0) if s.nan_to_zero else np.log(np.maximum(ev, s.floor))
        m = (vec * lg[..., None, :]) @ vec.swapaxes(-1, -2)
        out.append(np.stack([m[..., c, (c + o) % len(c)] for o in range(s.diagonals)], axis=2).reshape(len(m), -1))
    return np.concatenate(out) if out else np.zeros((0, len(s.bands) * s.diagonals * len(c)))


def spectral_features(df: DataFrame, keys, n: str, channels, setup: SpectralSetup = SpectralSetup(), frames_per_block=4096) -> DataFrame:
    """(keys, frame, last_n, features): blocks of frames with the samples the last one needs."""
    keys, channels = list(keys), list(channels)
    rows = frames_per_block * setup.stride
    h = halo(df.select(*keys, n, *channels), n, rows, 0, setup.context)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(n, kind="stable")
        first = int(pdf["hblk"].iloc[0]) * frames_per_block
        x = pdf[channels].to_numpy(dtype=float)
        f = spectral_rows(x, setup)[:frames_per_block] if len(x) > setup.context else []
        idx = first + np.arange(len(f))
        out = pd.DataFrame({"frame": idx, "last_n": idx * setup.stride + setup.context, "features": pd.Series([v.tolist() for v in f], dtype=object)})
        for i, c in enumerate(keys):
            out.insert(i, c, pdf[c].iloc[0])
        return out

    return h.groupBy(*keys, "hblk").applyInPandas(block, f"{kinds}, frame bigint, last_n bigint, features array<double>")


def fixed_lag(df: DataFrame, keys, n: str, channels, rate: float, scale: float, buffer: int, window: int, lag: int, hop: int) -> DataFrame:
    """Per hop: the buffer filtered zero-phase, its part ending `lag` rows before the end, over the scale."""
    keys, channels = list(keys), list(channels)
    d = hop_windows(df.select(*keys, n, *channels), n, buffer, hop, "j")
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "j", "last_n", *channels]
        if len(pdf) < buffer:
            return pd.DataFrame(columns=names)
        pdf = pdf.sort_values(n, kind="stable")
        x = pdf[channels].to_numpy(dtype=float)
        y = K.training_chain(x - np.median(x, axis=0), rate)[buffer - lag - window:buffer - lag] / scale
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), pdf["j"].iloc[0], int(pdf[n].iloc[buffer - lag - 1]), *[list(map(float, v)) for v in y.T]]], columns=names)

    return d.groupBy(*keys, "j").applyInPandas(one, f"{kinds}, j bigint, last_n bigint, " + ", ".join(f"{c} array<double>" for c in channels))


def review_envelope(snips: DataFrame, keys, order: str, channels, rate: float) -> DataFrame:
    """Activity per row of a bounded snippet: 20-450 Hz without mains harmonics, 25 ms RMS over channels."""
    keys, channels = list(keys), list(channels)
    kinds = ", ".join(f"`{c}` {snips.schema[c].dataType.simpleString()}" for c in keys)
    width = max(3, round(0.025 * rate))

    def one(rows):
        x = np.array([[r[c] for c in channels] for r in rows], dtype=float)
        spec = np.fft.rfft(x - np.median(x, axis=0), axis=0)
        f = np.fft.rfftfreq(len(x), 1.0 / rate)
        mains = np.arange(50.0, min(450.0, rate / 2) + 0.1, 50.0)
        near = (np.abs(f[:, None] - mains[None, :]) <= 3.0).any(axis=1)
        spec[(f < 20.0) | (f > min(450.0, rate / 2 - 1.0)) | near] = 0.0
        power = (np.fft.irfft(spec, n=len(x), axis=0) ** 2).mean(axis=1)
        w = min(width, len(power))
        pad = np.pad(power, (w // 2, w - 1 - w // 2), mode="edge")
        y = np.sqrt(np.maximum(np.convolve(pad, np.ones(w) / w, "valid"), 0.0))
        return [(*(r[k] for k in keys), r[order], float(v)) for r, v in zip(rows, y)]

    kind = snips.schema[order].dataType.simpleString()
    return grouped_rows(snips.select(*keys, order, *channels), keys, [order], one, [*keys, order, "activity"], f"{kinds}, {order} {kind}, activity double")


def examples(samples: DataFrame, prompts: DataFrame, keys, n: str, value: str, first: str, last: str, left: int, right: int, prompt_id: str, width: int) -> DataFrame:
    """Event-bounded snippet [first-left, last+right) per prompt, zeros where the recording has no rows.

    A prompt is bounded, so is its array; missing positions are those without a row.
    """
    from .joins import interval_join
    p = prompts.withColumns({"__a": F.col(first) - left, "__b": F.col(last) + right})
    hit = interval_join(samples.select(*keys, n, value), p.select(*keys, prompt_id, "__a", "__b"), keys, n, "__a", "__b", width)
    got = hit.groupBy(*keys, prompt_id).agg(F.map_from_entries(F.collect_list(F.struct(F.col(n), F.col(value)))).alias("__m"))
    d = p.join(got, [*keys, prompt_id], "left")
    x = F.transform(F.sequence(F.col("__a"), F.col("__b") - 1), lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(0.0)))
    return d.select(*keys, prompt_id, x.alias("x"), (F.col("__b") - F.col("__a")).alias("length"))
