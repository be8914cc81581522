"""Signal, packet and session quality as aggregates and rule rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import decibel
from .joins import small
from .ordered import exact_quantiles
from .sequences import difference

# fixed values: limits of the quality rules
ZERO_MAX, MAINS_MAX, ADJACENT_MAX, CLIP_MAX = 0.98, 0.35, 0.995, 0.001
LOST_MAX, DUPLICATE_MAX, LATE_MAX = 0.02, 0.01, 0.01


def channel_stats(long: DataFrame, keys, x: str, saturation: float) -> DataFrame:
    """RMS, peak-to-peak, saturated flag and status per (keys, channel) of long samples."""
    d = long.groupBy(*keys).agg(F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"), (F.max(x) - F.min(x)).alias("ptp"),
                                F.bool_or(F.abs(F.col(x)) >= saturation).alias("saturated"))
    return d.withColumn("status", F.when(F.col("saturated") | (F.col("ptp") == 0), "WARNING").otherwise("GOOD"))


def spread(long: DataFrame, keys, x: str, saturation: float) -> DataFrame:
    """Median, MAD, P95 of the deviation, saturation and zero shares, range."""
    med = exact_quantiles(long, keys, x, {"median": 0.5})
    dev = long.join(small(med), keys).withColumn("__d", F.abs(F.col(x) - F.col("median")))
    q = exact_quantiles(dev, keys, "__d", {"mad": 0.5, "p95": 0.95})
    share = lambda c: F.avg(c.cast("double"))
    plain = long.groupBy(*keys).agg(share(F.abs(F.col(x)) >= saturation).alias("saturation_ratio"), share(F.col(x) == 0).alias("zero_ratio"),
                                    (F.max(x) - F.min(x)).alias("ptp"))
    return plain.join(med, keys).join(q, keys)


def rest_report(samples: DataFrame, keys, channels, saturation: float, mains: DataFrame | None = None) -> DataFrame:
    """One graded row per key. `mains` has (keys, mains_ratio), the largest channel share."""
    long = samples.select(*keys, F.posexplode(F.array(*channels)).alias("ch", "x"))
    per = spread(long, [*keys, "ch"], "x", saturation)
    top = per.groupBy(*keys).agg(F.max("saturation_ratio").alias("sat"), F.max("zero_ratio").alias("zero"), F.min("ptp").alias("ptp"),
                                 F.max("mad").alias("mad"), F.max("p95").alias("p95"))
    adj = samples.groupBy(*keys).agg(F.greatest(*[F.abs(F.corr(a, b)) for a, b in zip(channels, channels[1:])]).alias("adjacent"))
    d = top.join(adj, keys)
    d = d.join(mains, keys, "left") if mains is not None else d.withColumn("mains_ratio", F.lit(None).cast("double"))
    why = F.array_compact(F.array(
        F.when(F.col("sat") > 0, "clipping"), F.when((F.col("zero") > ZERO_MAX) | (F.col("ptp") == 0), "flatline"),
        F.when(F.col("mains_ratio") > MAINS_MAX, "50hz_interference"),
        F.when(F.col("adjacent") > ADJACENT_MAX, "adjacent_channel_correlation")))
    return d.withColumns({"reasons": F.array_join(why, ","), "grade": F.when(F.size(why) == 0, "GOOD").otherwise("BAD")})


def spectrum_bins(blocks: DataFrame, keys, i: str, x: str, size: int, bins: range) -> DataFrame:
    """|X_k|^2 of each block for the wanted bins: sums of x cos and x sin.

    Blocks have a fixed length, so the work grows with rows times bins.
    """
    d = blocks.select(*keys, i, x, F.explode(F.sequence(F.lit(bins[0]), F.lit(bins[-1]))).alias("bin"))
    angle = F.lit(2.0 * 3.141592653589793) * (F.col("bin") * F.col(i) % size) / size
    g = d.groupBy(*keys, "bin").agg(F.sum(F.col(x) * F.cos(angle)).alias("re"), F.sum(F.col(x) * F.sin(angle)).alias("im"))
    return g.select(*keys, "bin", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def band_power(blocks: DataFrame, keys, i: str, x: str, size: int, rate: float) -> DataFrame:
    """Share of 45-55 Hz in all power, and 50 Hz against 44-47 and 53-56 Hz in decibel, per full block."""
    hz = rate / size
    lo, hi = int(44 // hz), min(int(56 // hz) + 1, size // 2)
    power = spectrum_bins(blocks, keys, i, x, size, range(lo, hi + 1)).withColumn("f", F.col("bin") * hz)
    # half-spectrum total without the mean, from the plain sums
    total = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), (F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.sum(x) / size).alias("ss"),
                                      F.sum(F.col(x) * F.when(F.col(i) % 2 == 0, 1.0).otherwise(-1.0)).alias("ny")).where(F.col("m") == size)
    f = F.col("f")
    g = power.groupBy(*keys).agg(
        F.sum(F.when(f.between(45, 55), F.col("power"))).alias("band"), F.avg(F.when(f.between(49, 51), F.col("power"))).alias("at50"),
        F.avg(F.when(f.between(44, 47) | f.between(53, 56), F.col("power"))).alias("near"))
    whole = (size * F.col("ss") + F.col("ny") * F.col("ny")) / 2
    out = g.join(total, keys)
    db = decibel((F.col("at50") + 1e-12) / (F.col("near") + 1e-12)) if size >= int(rate) else F.lit(float("-inf"))
    return out.select(*keys, (F.col("band") / F.greatest(whole, F.lit(1e-12))).alias("mains_ratio"), db.alias("line_db"))


def rolling_reasons(x_columns, saturation: float) -> Column:
    """Aggregate over a window: clipping and flat-line reasons."""
    clip, flat = F.lit(False), F.lit(False)
    for c in x_columns:
        clip = clip | (F.avg((F.abs(F.col(c)) >= saturation).cast("double")) > CLIP_MAX)
        flat = flat | (F.max(c) == F.min(c)) | (F.avg((F.col(c) == 0).cast("double")) > ZERO_MAX)
    return F.array_join(F.array_compact(F.array(F.when(clip, "clipping"), F.when(flat, "flatline_or_disconnected_channel"))), ",")


def packet_quality(audit: DataFrame, keys, lost="lost", duplicate="duplicate", late="late") -> DataFrame:
    total = F.greatest(F.lit(1), F.count(F.lit(1)) + F.sum(lost))
    d = audit.groupBy(*keys).agg((F.sum(lost) / total).alias("lost_ratio"), (F.sum(F.col(duplicate).cast("int")) / total).alias("duplicate_ratio"),
                                 (F.sum(F.col(late).cast("int")) / total).alias("late_ratio"))
    why = F.array_compact(F.array(F.when(F.col("lost_ratio") > LOST_MAX, "lost"), F.when(F.col("duplicate_ratio") > DUPLICATE_MAX, "duplicate"),
                                  F.when(F.col("late_ratio") > LATE_MAX, "late")))
    return d.withColumn("problems", F.array_join(why, ","))


def rate_audit(df: DataFrame, key: str, n: str, t_us: str, x: str, levels=(), gap_factor=2.5) -> DataFrame:
    """Rate from the slope of index on clock, step median and P95, bad steps, gaps, P99 amplitude."""
    d = difference(df, [key], [n], t_us, "__step", levels).withColumns({
        "__ms": F.col("__step") / 1000.0, "__a": F.abs(F.col(x))})
    base = d.groupBy(key).agg((F.regr_slope(F.col(n).cast("double"), F.col(t_us) / F.lit(1e6))).alias("rate_hz"),
                              F.count_if(F.col("__step") <= 0).alias("not_positive"))
    q = exact_quantiles(d, [key], "__ms", {"step_p50": 0.5, "step_p95": 0.95})
    a = exact_quantiles(d, [key], "__a", {"amp_p99": 0.99})
    gaps = d.join(small(q.select(key, "step_p50")), key).groupBy(key).agg(
        F.count_if(F.col("__ms") > gap_factor * F.col("step_p50")).alias("gaps"))
    return base.join(q, key, "left").join(a, key).join(gaps, key, "left")


def rule_rows(checks: DataFrame, keys, rules: dict[str, Column]) -> DataFrame:
    """(keys, rule, passed) for every rule of a wide fact row."""
    return checks.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("passed"))
                                                    for n, c in rules.items()])).alias("r")).select(*keys, "r.rule", "r.passed")


def gate(rules: DataFrame, keys) -> DataFrame:
    """passed/failed per key with the failed rules; the rule list has a fixed length."""
    bad = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("rule")))), ",")
    return rules.groupBy(*keys).agg(F.when(F.bool_and("passed"), "passed").otherwise("failed").alias("status"),
                                    F.count(F.lit(1)).alias("checks"), bad.alias("problems"))
