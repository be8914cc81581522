"""Ordered operators that never need a whole key in one task.

A window over (key) puts a hot key into a single task. Here each key is cut
into chunks that follow the order (a time slot, an index block, a score band).
Rows are windowed inside (key, chunk); one summary row per chunk is windowed
over the key; the summary is joined back on (key, chunk), which is how the rows
are already partitioned. `levels` may hold several chunkings, coarse to fine,
where one level of summaries would itself be too long.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FORWARD = ("index", "sum", "max", "min", "last", "last_before", "max_before", "lag", "sum_before")
BACKWARD = ("first_after", "first_from", "min_from", "max_from", "lead", "sum_after")


@dataclass(frozen=True)
class Running:
    """One running value: how it is combined and over which expression."""

    how: str
    expr: Column | None = None


def index() -> Running:
    return Running("index")


def running(how: str, expr) -> Running:
    return Running(how, F.col(expr) if isinstance(expr, str) else expr)


_MONOID = {
    "index": "sum", "sum": "sum", "sum_before": "sum", "max": "max", "max_before": "max", "min": "min",
    "last": "pick", "last_before": "pick", "lag": "pick", "first_after": "pick",
    "first_from": "pick", "lead": "pick", "min_from": "min", "max_from": "max", "sum_after": "sum",
}


def _over(monoid: str, col: Column, w) -> Column:
    if monoid == "sum":
        return F.coalesce(F.sum(col).over(w), F.lit(0))
    if monoid == "pick":
        return F.last(col, ignorenulls=True).over(w)
    return {"max": F.max, "min": F.min}[monoid](col).over(w)


def _merge(monoid: str, near: Column, far: Column) -> Column:
    if monoid == "sum":
        return near + F.coalesce(far, F.lit(0))
    if monoid == "pick":
        return F.coalesce(near, far)
    return {"max": F.greatest, "min": F.least}[monoid](near, far)


def _exclusive(df: DataFrame, keys, order, levels, items) -> DataFrame:
    """Add, for each (name, monoid, back, input, output), the value over the rows before (or after)."""
    part = list(keys) + (list(levels[-1]) if levels else [])
    fwd = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    bwd = (Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
           .rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumns({o: _over(m, F.col(i), bwd if b else fwd) for m, b, i, o in items})
    if not levels:
        return out
    pos = F.struct(*order)
    agg = []
    for m, b, i, o in items:
        c = F.col(i)
        if m == "sum":
            agg.append(F.sum(c).alias(i))
        elif m == "pick":
            agg.append((F.min_by if b else F.max_by)(c, F.when(c.isNotNull(), pos)).alias(i))
        else:
            agg.append({"max": F.max, "min": F.min}[m](c).alias(i))
    summary = df.groupBy(*part).agg(*agg)
    carried = _exclusive(summary, keys, list(levels[-1]), levels[:-1], items)
    carried = carried.select(*part, *[F.col(o).alias(f"{o}_far") for *_, o in items])
    out = out.join(carried, part, "left")
    merged = {o: _merge(m, F.col(o), F.col(f"{o}_far")) for m, _, _, o in items}
    return out.withColumns(merged).drop(*[f"{o}_far" for *_, o in items])


def scan(df: DataFrame, keys, order, outputs: dict[str, Running], levels=()) -> DataFrame:
    """Add running values to every row.

    keys    columns of one ordered sequence (may be empty when `levels` is given)
    order   ascending columns that give a total order inside a key
    levels  chunk columns, coarse to fine; each must follow `order`
    """
    if not keys and not levels:
        raise ValueError("a global order needs chunk levels")
    items, inputs = [], {}
    for name, spec in outputs.items():
        inp, out = f"__in_{name}", f"__ex_{name}"
        if spec.how == "index":
            inputs[inp] = F.lit(1).cast("bigint")
        elif spec.how in ("lag", "lead"):
            inputs[inp] = F.struct(spec.expr.alias("v"))
        else:
            inputs[inp] = spec.expr
        items.append((_MONOID[spec.how], spec.how in BACKWARD, inp, out))
    out = _exclusive(df.withColumns(inputs), list(keys), list(order), list(levels), items)
    final = {}
    for name, spec in outputs.items():
        own, ex = F.col(f"__in_{name}"), F.col(f"__ex_{name}")
        final[name] = {
            "index": lambda: ex, "sum_before": lambda: ex, "sum_after": lambda: ex, "sum": lambda: ex + F.coalesce(own, F.lit(0)),
            "max": lambda: F.greatest(own, ex), "min": lambda: F.least(own, ex),
            "max_before": lambda: ex, "last_before": lambda: ex, "first_after": lambda: ex,
            "last": lambda: F.coalesce(own, ex), "first_from": lambda: F.coalesce(own, ex),
            "lag": lambda: ex["v"], "lead": lambda: ex["v"],
            "min_from": lambda: F.least(own, ex), "max_from": lambda: F.greatest(own, ex),
        }[spec.how]()
    return out.withColumns(final).drop(*inputs, *[o for *_, o in items])


def micros(ts) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def time_slot(ts, seconds: int = 3_600) -> Column:
    """Chunk column for a timestamp; an hour of a 250 Hz stream is 900,000 rows."""
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000))


def block(idx, rows: int = 65_536) -> Column:
    """Chunk column for a dense index: at most `rows` rows each."""
    return F.floor(F.col(idx) / F.lit(rows))


def value_band(v, parts: int = 1024) -> Column:
    """Order-keeping band of a finite double: sign and 1/`parts` octaves of its size.

    A key has at most `parts` bands per octave, so the summary over its bands stays small while its rows spread over many of them.
    """
    c = F.col(v) if isinstance(v, str) else v
    size = F.floor(F.log2(F.greatest(F.abs(c), F.lit(1e-300))) * parts) + F.lit(1_250 * parts)
    return F.when(c == 0, F.lit(0)).otherwise(F.signum(c).cast("bigint") * size)


def number_rows(df, keys, order, name="n", levels=()):
    return scan(df, keys, order, {name: index()}, levels)


def exact_quantiles(df: DataFrame, keys, value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact linear quantiles per key, safe for hot keys.

    Equal values are counted first (map-side), then ranked through value bands,
    so no task holds all values of a key. Small bounded groups should use the
    built-in `percentile`.
    """
    keys = list(keys)
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
              .withColumn("__band", value_band(value)))
    # the total of a key is what lies before, at and after a row; no join on the key itself
    ranked = scan(counts, keys, [value], {"__before": running("sum_before", "__c"), "__after": running("sum_after", "__c")}, [["__band"]])
    ranked = ranked.withColumn("__total", F.col("__before") + F.col("__c") + F.col("__after"))
    aggs, final = [], []
    for name, p in wanted.items():
        pos = F.lit(float(p)) * (F.col("__total") - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (at >= F.col("__before")) & (at < F.col("__before") + F.col("__c"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"{name}_{tag}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"{name}_fr"))
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        final.append((lo + (hi - lo) * F.col(f"{name}_fr")).alias(name))
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *final)


def weighted_medians(df: DataFrame, keys, value: str, weight: str, name: str) -> DataFrame:
    """First value whose running weight reaches half of the total, per key."""
    keys = list(keys)
    merged = (df.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
              .withColumn("__band", value_band(value)))
    ranked = scan(merged, keys, [value], {"__cum": running("sum", "__w"), "__after": running("sum_after", "__w")}, [["__band"]])
    return (ranked.where(F.col("__cum") >= F.lit(0.5) * (F.col("__cum") + F.col("__after")))
            .groupBy(*keys).agg(F.min(value).alias(name)))


def join_all(frames, keys, how="inner") -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, how), frames)
