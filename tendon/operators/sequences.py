"""Ordered operators on samples and events, built on chunked scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from .ordered import index, running, scan


def runs(df, keys, order, value: str, levels=()) -> DataFrame:
    """Rows tagged with `run`: it changes whenever `value` changes."""
    d = scan(df, keys, order, {"__before": running("lag", value)}, levels)
    flag = (F.col("__before").isNull() | (F.col("__before") != F.col(value))).cast("bigint")
    return scan(d.withColumn("__new", flag), keys, order, {"run": running("sum", "__new")}, levels).drop("__before", "__new")


def run_table(df, keys, order, value: str, pos: str, levels=()) -> DataFrame:
    return runs(df, keys, order, value, levels).groupBy(*keys, "run").agg(
        F.first(value).alias(value), F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.count(F.lit(1)).alias("rows"))


def first_sustained(df, keys, order, cond: Column, m: int, pos: str, levels=()) -> DataFrame:
    """First position where `cond` holds for m rows in a row, per key."""
    t = run_table(df.withColumn("__c", cond), keys, order, "__c", pos, levels)
    return t.where(F.col("__c") & (F.col("rows") >= m)).groupBy(*keys).agg(F.min("first_pos").alias("first_pos"))


def rising_edges(df, keys, order, value, threshold, levels=()) -> DataFrame:
    """Rows at or over the threshold whose predecessor is under it; a first row counts."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    d = scan(df.withColumn("__up", col(value) >= t), keys, order, {"__was": running("lag", "__up")}, levels)
    return d.where(F.col("__up") & ~F.coalesce(F.col("__was"), F.lit(False))).drop("__up", "__was")


def arbitrate(df, keys, p: str, label: str) -> DataFrame:
    """One row per frame: the highest probability, the first label on a tie."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct((-F.col(p)).alias("p"), F.col(label).alias("l")))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def envelope(df, keys, order, start, end, levels=()) -> DataFrame:
    """Running maximum of starts and, from the end, running minimum of ends."""
    return scan(df, keys, order, {"start_env": running("max", start), "end_env": running("min_from", end)}, levels)


def halo(df: DataFrame, n: str, rows: int, before: int, after: int, name="hblk") -> DataFrame:
    """Rows repeated into neighbouring blocks, so that every row meets `before` and `after` rows in its own block.

    `own` marks the copy that belongs to the block. Blocks hold at most rows + before + after rows.
    """
    own = F.floor(F.col(n) / rows)
    lo = F.greatest(F.lit(0), F.floor((F.col(n) - after) / F.lit(rows)))
    hi = F.floor((F.col(n) + before) / F.lit(rows))
    return df.withColumn(name, F.explode(F.sequence(lo.cast("bigint"), hi))).withColumn("own", F.col(name) == own)


def smooth(df, keys, n: str, value: str, width: int, name="smooth", rows=16_384) -> DataFrame:
    """Centred moving mean of `width` rows with the end values repeated outside."""
    left, right = width // 2, width - 1 - width // 2
    h = halo(df, n, rows, left, right)
    w = Window.partitionBy(*keys, "hblk").orderBy(n).rowsBetween(-left, right)
    have_left = F.least(F.col(n), F.lit(left))
    have_right = F.count(F.lit(1)).over(w) - 1 - have_left
    s = (F.sum(value).over(w) + (left - have_left) * F.first(value).over(w) + (right - have_right) * F.last(value).over(w))
    return h.withColumn(name, s / width).where("own").drop("hblk", "own")


def pair_stages(df, keys, order, is_start: Column, is_end: Column, payload: Column, levels=()) -> DataFrame:
    """END rows with the latest START since the previous END."""
    pos = F.struct(*order)
    d = scan(df, keys, order, {
        "__s": running("last_before", F.when(is_start, F.struct(pos.alias("pos"), payload.alias("v")))),
        "__e": running("last_before", F.when(is_end, pos))}, levels)
    return d.where(is_end & F.col("__s").isNotNull() & (F.col("__e").isNull() | (F.col("__s.pos") > F.col("__e")))) \
        .withColumn("start", F.col("__s.v")).drop("__s", "__e")


def overlap_groups(df, keys, order, start, end, levels=()) -> DataFrame:
    """Rows tagged with `grp`; a group grows while a start is not after the largest end so far."""
    d = scan(df, keys, order, {"__top": running("max_before", end)}, levels)
    d = d.withColumn("__new", (F.col("__top").isNull() | (F.col(start) > F.col("__top"))).cast("bigint"))
    return scan(d, keys, order, {"grp": running("sum", "__new")}, levels).drop("__top", "__new")


def difference(df, keys, order, value, name="diff", levels=()) -> DataFrame:
    d = scan(df, keys, order, {"__p": running("lag", value)}, levels)
    return d.withColumn(name, F.col(value) - F.col("__p")).drop("__p")


def resample_index(df, keys, n: str, src: float, dst: float, levels=()) -> DataFrame:
    """Target rows `i` of each source row: i takes source rint(i*src/dst), clipped to the last one.

    Each source row makes its own few targets; the last row also takes the clipped ones.
    """
    d = scan(df, keys, [n], {"__next": running("lead", n)}, levels)
    ratio = src / dst
    lo = F.greatest(F.lit(0), F.ceil((F.col(n) - 0.5) / ratio) - 1).cast("bigint")
    hi = F.floor((F.col(n) + 0.5) / ratio).cast("bigint") + 1
    count = F.ceil((F.col(n) + 1) / F.lit(ratio)).cast("bigint")
    last = F.col("__next").isNull()
    i = F.explode(F.sequence(lo, F.when(last, F.greatest(hi, count)).otherwise(hi)))
    out = d.withColumn("i", i).withColumn("__at", F.rint(F.col("i") * F.lit(ratio)))
    hit = (F.col("__at") == F.col(n)) | (last & (F.col("__at") > F.col(n)))
    return out.where(hit & (~last | (F.col("i") < count))).drop("__next", "__at")


def onset_lag(df, keys, order, t: str, arm: Column, hand: Column, limit: float, levels=()) -> DataFrame:
    """Latest hand onset minus latest arm onset, kept within the limit."""
    d = scan(df, keys, order, {"__a": running("last", F.when(arm, F.col(t))), "__h": running("last", F.when(hand, F.col(t)))}, levels)
    lag = F.col("__h") - F.col("__a")
    return d.withColumn("lag", F.when(F.abs(lag) <= limit, lag)).drop("__a", "__h")


def segments(df, keys, order, idx: str, levels=()) -> DataFrame:
    """Rows tagged with `segment`; any index step other than 1 starts a new one."""
    d = scan(df, keys, order, {"__p": running("lag", idx)}, levels)
    d = d.withColumn("__new", (F.col("__p").isNotNull() & (F.col(idx) - F.col("__p") != 1)).cast("bigint"))
    return scan(d, keys, order, {"segment": running("sum", "__new")}, levels).drop("__p", "__new")


def trial_bounds(df, keys, order, start, end, levels=()) -> DataFrame:
    """Rows with `overlaps`: the start lies before the largest earlier end."""
    d = scan(df, keys, order, {"__top": running("max_before", end)}, levels)
    return d.withColumn("overlaps", F.coalesce(F.col(start) < F.col("__top"), F.lit(False))).drop("__top")


def propagate(events: DataFrame, trials: DataFrame, trial="trial_id", ok="ok", valid="valid") -> DataFrame:
    """An event is included if its trial is valid and every event of the trial passes.

    The all-events flag is a small aggregate joined back, not a window over the trial.
    """
    flag = events.groupBy(trial).agg(F.bool_and(ok).alias("all_ok"))
    whole = flag.join(trials.select(trial, valid), trial, "left")
    out = events.join(whole, trial)
    good = F.coalesce(F.col(valid), F.lit(False))
    reason = (F.when(~F.col(ok), "low_quality").when(~F.col("all_ok"), "paired_event_failed")
              .when(~good, "invalid_trial").otherwise(""))
    return out.withColumns({"included": good & F.col("all_ok"), "reason": reason}).drop("all_ok", valid)


def numbered(df, keys, order, name="n", levels=()) -> DataFrame:
    return scan(df, keys, order, {name: index()}, levels)


def first_distinct(df, keys, order, levels=None) -> DataFrame:
    """First row per key by a full order; an aggregate, so duplicates merge map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("b")).select(*keys, "b.*")


def peak_quality(df, scores: str, min_confidence=0.20) -> DataFrame:
    """Best candidate, best one at least 3 steps away, confidence and reasons per row of scores."""
    # fixed values: minimum correlation 0.25, minimum margin 0.05
    s = F.transform(col(scores), lambda x: x.cast("double"))
    d = df.withColumn("__s", s).withColumn("chosen", F.array_position("__s", F.array_max("__s")) - 1)
    far = F.filter(F.col("__s"), lambda x, i: F.abs(i - F.col("chosen")) >= 3)
    d = d.withColumns({"best": F.array_max("__s"), "second": F.coalesce(F.array_max(far), F.lit(-1.0))})
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    d = d.withColumns({
        "confidence": 0.7 * unit((F.col("best") - 0.05) / 0.45) + 0.3 * unit((F.col("best") - F.col("second")) / 0.12),
        "boundary": (F.col("chosen") == 0) | (F.col("chosen") == F.size("__s") - 1)})
    why = F.array_join(F.array_compact(F.array(
        F.when(F.col("boundary"), "search_boundary_hit"), F.when(F.col("confidence") < min_confidence, "low_confidence"),
        F.when(F.col("best") < 0.25, "low_template_correlation"),
        F.when(F.col("best") - F.col("second") < 0.05, "ambiguous_template_peak"))), ",")
    return d.withColumn("reasons", why).drop("__s")
