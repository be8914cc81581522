"""Range, as-of and nearest joins built from equi-joins and ordered scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running, scan

SMALL_SIDE_BYTES = 64 << 20


def small(df: DataFrame, limit: int = SMALL_SIDE_BYTES) -> DataFrame:
    """Broadcast `df` only if the optimizer's own size estimate is under `limit`."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def interval_join(points: DataFrame, spans: DataFrame, keys, t: str, start: str, end: str,
                  width: float, closed: bool = False, how: str = "inner") -> DataFrame:
    """Rows of `points` whose time lies in [start, end) of a row of `spans`.

    Both sides get a slot of `width` time units; a span is repeated once per
    slot it touches. The join is an equi-join on (keys, slot), so one busy key
    spreads over its slots.
    """
    keys = list(keys)
    p = points.withColumn("__slot", F.floor(F.col(t) / F.lit(width)))
    s = spans.withColumn("__slot", F.explode(F.sequence(
        F.floor(F.col(start) / F.lit(width)), F.floor(F.col(end) / F.lit(width)))))
    upper = F.col(t) <= F.col(end) if closed else F.col(t) < F.col(end)
    both = (p.alias("p").join(s.alias("s"), [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
                              + [F.col("p.__slot") == F.col("s.__slot"), F.col(t) >= F.col(start), upper], how))
    if how in ("left_semi", "left_anti"):
        return both.drop("__slot")
    return both.select("p.*", *[F.col(f"s.{c}") for c in spans.columns if c not in keys]).drop("__slot")


def asof_neighbours(fast: DataFrame, slow: DataFrame, keys, t: str, value: str, slot: Column) -> DataFrame:
    """For each fast row: the slow row at or before it and the first one after it.

    Union of both streams and a chunked scan; there is no all-pairs step. The
    slow row sorts first at equal times. Of slow rows at one time the first kept
    row is used (callers de-duplicate).
    """
    f = fast.withColumn("__side", F.lit(1)).withColumn("__s", F.lit(None).cast("struct<t:double,v:double>"))
    s = (slow.select(*keys, t, value).withColumn("__side", F.lit(0))
         .withColumn("__s", F.struct(F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("v")))
         .drop(value))
    both = f.unionByName(s, allowMissingColumns=True).withColumn("__slot", slot)
    # every slow row of a time precedes the fast rows of that time
    out = scan(both, keys, [t, "__side"],
               {"__prev": running("last_before", "__s"), "__next": running("first_after", "__s")}, [["__slot"]])
    return (out.where("__side = 1")
            .withColumns({"prev_t": F.col("__prev.t"), "prev_v": F.col("__prev.v"),
                          "next_t": F.col("__next.t"), "next_v": F.col("__next.v")})
            .drop("__side", "__s", "__slot", "__prev", "__next"))


def align_linear(fast: DataFrame, slow: DataFrame, keys, t: str, value: str, slot: Column,
                 max_gap: float, exact_gap: float) -> DataFrame:
    """Slow value on the fast grid: linear between neighbours, clamped at the ends.

    `valid` needs both ends around the time and the nearer one within `max_gap`;
    `interpolated` is set when the nearer one is over `exact_gap` away.
    """
    # the slow stream keeps the first row of a repeated time
    n = asof_neighbours(fast, slow, keys, t, value, slot)
    x = F.col(t).cast("double")
    exact = F.col("prev_t") == x
    # a slow row at exactly the time is its own right-hand neighbour
    share = (x - F.col("prev_t")) / (F.col("next_t") - F.col("prev_t"))
    lerp = (F.when(exact, F.col("prev_v")).when(F.col("prev_t").isNull(), F.col("next_v"))
            .when(F.col("next_t").isNull(), F.col("prev_v"))
            .otherwise(F.col("prev_v") + (F.col("next_v") - F.col("prev_v")) * share))
    gap = F.least(x - F.col("prev_t"), F.col("next_t") - x)
    inside = F.col("prev_t").isNotNull() & (exact | F.col("next_t").isNotNull())
    return n.withColumns({"aligned": lerp, "gap": gap, "valid": F.coalesce(inside & (gap <= max_gap), F.lit(False)),
                          "interpolated": gap > exact_gap})


def nearest(fast: DataFrame, slow: DataFrame, keys, t: str, value: str, slot: Column) -> DataFrame:
    """Nearest slow row in time; the earlier one wins a tie."""
    n = asof_neighbours(fast, slow, keys, t, value, slot)
    x = F.col(t).cast("double")
    left = F.col("prev_t").isNotNull() & (F.col("next_t").isNull() | (x - F.col("prev_t") <= F.col("next_t") - x))
    return n.withColumns({"near_t": F.when(left, F.col("prev_t")).otherwise(F.col("next_t")),
                          "near_v": F.when(left, F.col("prev_v")).otherwise(F.col("next_v"))})
