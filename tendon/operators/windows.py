"""Hop windows over a dense sample index, and what is said about each window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, let


def hop_windows(df: DataFrame, n: str = "n", size: int = 40, hop: int = 8, name: str = "j") -> DataFrame:
    """Repeat each row once per window [j*hop, j*hop+size) that holds it."""
    first = F.greatest(F.lit(0), F.ceil((F.col(n) - (size - 1)) / F.lit(hop)))
    return df.withColumn(name, F.explode(F.sequence(first.cast("bigint"), F.floor(F.col(n) / F.lit(hop)))))


def window_agg(df: DataFrame, keys, aggs, n="n", size=40, hop=8, name="j") -> DataFrame:
    """One row per full window; groups are bounded by `size`, so a long trial spreads over tasks."""
    out = hop_windows(df, n, size, hop, name).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("__rows"), *aggs)
    return out.where(F.col("__rows") == size).drop("__rows")


def ordered_values(value, order="n") -> Column:
    """Values of a bounded group as an array in row order (aggregate)."""
    return F.transform(F.array_sort(F.collect_list(F.struct(col(order).alias("o"), col(value).alias("v")))),
                       lambda s: s["v"])


def ordered_mean(value, order="n") -> Column:
    """Mean of a bounded group, summed in row order (aggregate): unlike `avg`, its last bits do not depend on where the rows come from, so a mean on a threshold falls on one side."""
    def mean(values):
        return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))
    return let(F.filter(ordered_values(col(value).cast("double"), order), lambda x: x.isNotNull()), mean)


def label_mode(label) -> Column:
    """Most frequent non-negative label, smallest on ties, -1 if none (aggregate over a bounded group)."""
    def pick(labels):
        ranked = F.transform(F.array_distinct(labels), lambda x: F.struct(
            F.size(F.filter(labels, lambda y: y == x)).alias("c"), (-x).alias("v")))
        return -F.array_max(ranked)["v"]
    return F.coalesce(let(F.collect_list(F.when(col(label) >= 0, col(label))), pick), F.lit(-1))


def eligible(stable="stable", quality=None, missing="missing", time_ok=None, imu_ok=None,
             stable_share=0.9, min_quality=0.8, max_missing=0.1, order="n") -> list[Column]:
    """Aggregates `ok_*` whose conjunction is window eligibility."""
    share = lambda c: F.avg(col(c).cast("double"))
    out = [(share(stable) >= stable_share).alias("ok_stable"), (share(missing) <= max_missing).alias("ok_missing")]
    if quality is not None:
        out.append((ordered_mean(quality, order) >= min_quality).alias("ok_quality"))
    if time_ok is not None:
        out.append(F.bool_and(time_ok).alias("ok_time"))
    if imu_ok is not None:
        out.append((share(imu_ok) >= 1.0 - max_missing).alias("ok_imu"))
    return out


def window_weights(df: DataFrame, session="session_no", trial="trial_id", name="weight") -> DataFrame:
    """Equal weight per session, then trial, then window; the mean is 1."""
    per_trial = df.groupBy(session, trial).agg(F.count(F.lit(1)).alias("__w"))
    per_session = per_trial.groupBy(session).agg(F.count(F.lit(1)).alias("__t"), F.sum("__w").alias("__sw"))
    mean = per_session.agg((F.sum("__sw") / F.count(F.lit(1))).alias("m")).scalar()  # windows per session on average
    # one row per session: the share of a window of that session before the trial split
    share = per_session.select(session, (mean / F.col("__t")).alias("__share"))
    per_trial = per_trial.join(share, session).select(session, trial, (F.col("__share") / F.col("__w")).alias(name))
    return df.join(per_trial, [session, trial])
