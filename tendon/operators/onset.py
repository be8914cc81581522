"""Movement onset near a cue from the energy envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let, total
from ..functions.signal import array_median, diffs
from .linking import snippets
from .sequences import smooth


def energy_envelope(df: DataFrame, keys, n: str, channels, rate: float) -> DataFrame:
    """Slow drift removed over 100 ms, root mean square over channels, smoothed over 25 ms."""
    d, keys = df, list(keys)
    for c in channels:
        d = smooth(d, keys, n, c, max(3, round(0.100 * rate)), f"__s_{c}")
    power = F.sqrt(sum((F.col(c) - F.col(f"__s_{c}")) ** 2 for c in channels) / len(channels))
    d = d.withColumn("__p", power).drop(*[f"__s_{c}" for c in channels])
    return smooth(d, keys, n, "__p", max(3, round(0.025 * rate)), "envelope").drop("__p")


def _quantile(a: Column, p: float) -> Column:
    def at(s):
        pos = F.lit(p) * (F.size(s) - 1)
        lo = F.get(s, F.floor(pos).cast("int"))
        hi = F.get(s, F.ceil(pos).cast("int"))
        return lo + (hi - lo) * (pos - F.floor(pos))
    return let(F.array_sort(a), at)


def _moving(a: Column, width: int) -> Column:
    """Centred moving mean with the ends repeated."""
    left = width // 2
    def mean(x):
        n = F.size(x)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: total(F.transform(F.sequence(i - left, i - left + width - 1), lambda j: F.get(
            x, F.least(F.greatest(j, F.lit(0)), n - 1).cast("int")))) / width)
    return let(a, mean)


def cue_onsets(df: DataFrame, cues: DataFrame, keys, n: str, cue_id: str, cue: str, name: str, rate: float, releases) -> DataFrame:
    """(.., cue id, onset row, confidence, method); df has `envelope`. A cue meets a bounded number of rows."""
    s = lambda sec: round(sec * rate)
    m = max(1, s(0.020))
    sn = snippets(df.select(*keys, n, "envelope"), cues.select(*keys, cue_id, cue, name), keys, n, cue, s(0.45), max(s(0.80), s(0.75)) - 1, width=4 * max(1, s(0.8)))
    g = sn.groupBy(*keys, cue_id, cue, name).agg(F.array_sort(F.collect_list(F.struct(F.col("offset").alias("o"), F.col("envelope").alias("e")))).alias("r"))
    part = lambda lo, hi: F.transform(F.filter("r", lambda x: (x["o"] >= lo) & (x["o"] < hi)), lambda x: x["e"])
    g = g.select(*keys, cue_id, cue, name, part(-s(0.45), -s(0.15)).alias("before"), part(0, s(0.80)).alias("search"),
                 part(-s(0.30), -s(0.03)).alias("active"), part(s(0.30), s(0.75)).alias("late"))
    g = g.where((F.size("search") > 1) & (F.size("before") > 0))
    g = g.withColumn("rest0", array_median(F.col("before"))).withColumn(
        "noise", F.greatest(array_median(F.transform("before", lambda v: F.abs(v - F.col("rest0")))), F.lit(1e-12)))
    fall = F.col(name).isin(*releases)
    low = F.when(F.size("late") > 0, _quantile(F.col("late"), 0.30)).otherwise(F.array_min("search"))
    g = g.withColumns({"hi": F.when(fall, array_median(F.col("active"))).otherwise(_quantile(F.col("search"), 0.90)), "lo": F.when(fall, low).otherwise(F.col("rest0"))})
    g = g.withColumn("contrast", F.col("hi") - F.col("lo")).withColumn("limit", F.when(
        fall, F.col("lo") + 0.65 * F.greatest(F.col("contrast"), F.lit(0.0))).otherwise(
        F.col("lo") + F.greatest(4.0 * F.col("noise"), 0.25 * F.greatest(F.col("contrast"), F.lit(0.0)))))
    hit = F.transform("search", lambda v: F.when(fall, v <= F.col("limit")).otherwise(v >= F.col("limit")))
    starts = let(hit, lambda h: F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i + m <= F.size(h)) & F.forall(F.slice(h, i + 1, F.lit(m)), lambda b: b)))
    slope = _moving(F.concat(F.array(F.lit(0.0)), diffs(F.col("search"))), m)
    steep = let(slope, lambda d: F.array_position(d, F.when(fall, F.array_min(d)).otherwise(F.array_max(d))) - 1)
    g = g.withColumn("first", F.get(starts, F.lit(0)))
    sure = F.col("first").isNotNull() & (F.col("contrast") > 0)
    kind = F.concat(F.lit("energy_"), F.when(fall, "fall").otherwise("rise"), F.when(sure, "").otherwise("_fallback"), F.lit("_v1"))
    conf = F.least(F.greatest(F.col("contrast") / (6.0 * F.col("noise")), F.lit(0.0)), F.lit(1.0))
    return g.select(*keys, cue_id, (F.col(cue) + F.when(sure, F.col("first")).otherwise(steep)).alias("onset"), conf.alias("confidence"), kind.alias("method"))
