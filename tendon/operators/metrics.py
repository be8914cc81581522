"""Scores of predictions against truth. -1 is a rejection: an error, never a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from .ordered import running, scan


def confusion(df: DataFrame, truth="truth", pred="pred", weight: Column | None = None, keys=()) -> DataFrame:
    """Weight per (truth, pred); everything below starts from this small table."""
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(*keys, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"))


def class_f1(conf: DataFrame, keys=()) -> DataFrame:
    keys = list(keys)
    hit = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("w")).otherwise(0.0))
    by_truth = conf.groupBy(*keys, F.col("truth").alias("label")).agg(F.sum("w").alias("actual"), hit.alias("tp"))
    by_pred = conf.groupBy(*keys, F.col("pred").alias("label")).agg(F.sum("w").alias("claimed"))
    both = by_truth.join(by_pred, keys + ["label"], "left").fillna(0.0, ["claimed"])
    size = F.col("actual") + F.col("claimed")  # 2tp + fp + fn
    return both.withColumn("f1", F.when(size == 0, 0.0).otherwise(2 * F.col("tp") / size))


def macro_f1(df, truth="truth", pred="pred", weight=None, keys=()) -> DataFrame:
    return class_f1(confusion(df, truth, pred, weight, keys), keys).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def ece(df: DataFrame, q="q", weight=None, bins=10, truth="truth", pred="pred") -> DataFrame:
    """Calibration error over equal bins; the last one holds 1.0."""
    w = F.lit(1.0) if weight is None else weight
    b = F.least(F.floor(F.col(q) * bins), F.lit(bins - 1)).alias("bin")
    per = df.groupBy(b).agg(F.sum(w).alias("w"), F.sum(w * (F.col(truth) == F.col(pred)).cast("double")).alias("hit"),
                            F.sum(w * F.col(q)).alias("conf"))
    return per.agg((F.sum(F.abs(F.col("hit") - F.col("conf"))) / F.sum("w")).alias("ece"))


def weighted_share(cond: Column, weight: Column) -> Column:
    return F.sum(weight * cond.cast("double")) / F.sum(weight)


def class_coverage(df, weight, truth="truth", pred="pred") -> DataFrame:
    return df.groupBy(F.col(truth).alias("label")).agg(weighted_share(F.col(pred) >= 0, weight).alias("coverage"))


def joint_accuracy(df, weight, heads=(("truth", "pred"), ("truth2", "pred2"))) -> DataFrame:
    both = F.lit(True)
    for t, p in heads:
        both = both & (F.col(t) == F.col(p))
    return df.agg(weighted_share(both, weight).alias("joint_accuracy"),
                  *[weighted_share(F.col(p) >= 0, weight).alias(f"coverage_{i + 1}") for i, (_, p) in enumerate(heads)])


def risk_coverage(df: DataFrame, row_id: str, weight: Column, points=(1.0, 0.9, 0.8, 0.7, 0.6, 0.5),
                  truth="truth", pred="pred", q="q", id_block=65_536) -> DataFrame:
    """(target, threshold, coverage, risk) from the most confident row down; ties go by row id."""
    base = df.select(F.col(row_id).alias("__id"), (-F.col(q)).alias("__nq"), weight.alias("__w"),
                     F.col(pred).alias("__p"), (F.col(pred) != F.col(truth)).cast("double").alias("__bad"))
    whole = base.agg(F.sum("__w").alias("__all"), F.sum(F.when(F.col("__p") >= 0, F.col("__w"))).alias("__max"))
    kept = base.where("__p >= 0").withColumns({
        "__qb": F.floor(F.col("__nq") * 1024), "__qf": F.floor(F.col("__nq") * (1 << 20)), "__ib": F.floor(F.col("__id") / id_block)})
    ranked = scan(kept, [], ["__nq", "__id"],
                  {"cw": running("sum", "__w"), "cb": running("sum", F.col("__w") * F.col("__bad"))},
                  [["__qb"], ["__qb", "__qf"], ["__qb", "__qf", "__nq", "__ib"]])
    ranked = ranked.withColumns({c: whole.select(c).scalar() for c in ("__all", "__max")})
    target = [F.least(F.col("__max") / F.col("__all"), F.lit(p)) for p in points]
    hits = ranked.agg(*[F.min(F.when(F.col("cw") >= t * F.col("__all"),
                                     F.struct("__nq", "__id", "cw", "cb", t.alias("target"), "__all"))).alias(f"t{i}")
                        for i, t in enumerate(target)])
    out = hits.select(F.explode(F.array_distinct(F.array(*[f"t{i}" for i in range(len(points))]))).alias("r"))
    return (out.where("r IS NOT NULL").select(
        F.col("r.target").alias("target"), (-F.col("r.__nq")).alias("threshold"),
        (F.col("r.cw") / F.col("r.__all")).alias("coverage"), (F.col("r.cb") / F.col("r.cw")).alias("risk")))


def fit_temperature(df: DataFrame, logits: str, label: str, weight: Column, low=0.25, high=4.0, n=81) -> DataFrame:
    """Temperature with the lowest weighted log loss on a log grid; the first wins."""
    from ..functions.columns import as_doubles, log_grid, total
    base = df.select(as_doubles(logits).alias("z"), F.col(label).cast("int").alias("y"), weight.alias("w"))
    base = base.select("w", F.array_max("z").alias("top"), F.get("z", F.col("y")).alias("zy"), "z")
    rows = base.select("*", F.posexplode(log_grid(low, high, n)).alias("i", "temperature"))
    t, top = F.col("temperature"), F.col("top")
    p = F.exp(F.col("zy") / t - top / t) / total(F.transform("z", lambda v: F.exp(v / t - top / t)))
    loss = -F.log(F.least(F.greatest(p, F.lit(1e-9)), F.lit(1.0)))
    per = rows.groupBy("i", "temperature").agg((F.sum(F.col("w") * loss) / F.sum("w")).alias("nll"))
    return per.agg(F.min(F.struct(F.round("nll", 12).alias("nll"), "i", "temperature")).alias("b")).select(
        F.col("b.temperature").alias("temperature"), F.col("b.nll").alias("nll"))


def fit_threshold(df: DataFrame, weight: Column, truth="truth", pred="raw", q="q", min_coverage=0.90,
                  min_class=0.75, step=0.01, n=96) -> DataFrame:
    """Rejection threshold: enough coverage, then best (F1, -risk, threshold).

    Rows are first counted per (truth, pred, number of passed thresholds), so
    the grid meets a table whose size does not depend on the data.
    """
    grid = F.array(*[F.lit(step * i) for i in range(n)])
    level = F.size(F.filter(grid, lambda t: t <= F.col(q)))
    small = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred"), level.alias("lv")).agg(F.sum(weight).alias("w"))
    g = small.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumns({
        "acc": F.when(F.col("lv") > F.col("i"), F.col("w")).otherwise(0.0)})
    cls = g.groupBy("i", F.col("truth").alias("label")).agg(
        F.sum("w").alias("actual"), F.sum("acc").alias("kept"),
        F.sum(F.when(F.col("truth") == F.col("pred"), F.col("acc")).otherwise(0.0)).alias("tp"))
    claimed = g.groupBy("i", F.col("pred").alias("label")).agg(F.sum("acc").alias("claimed"))
    both = cls.join(claimed, ["i", "label"], "left").fillna(0.0, ["claimed"])
    f1 = F.when(F.col("actual") + F.col("claimed") == 0, 0.0).otherwise(2 * F.col("tp") / (F.col("actual") + F.col("claimed")))
    per = both.groupBy("i").agg(
        F.avg(f1).alias("f1"), (F.sum("kept") / F.sum("actual")).alias("coverage"),
        F.min(F.col("kept") / F.col("actual")).alias("least"),
        (F.lit(1.0) - F.sum("tp") / F.nullif(F.sum("kept"), F.lit(0.0))).alias("risk"))
    ok = (F.col("coverage") >= min_coverage) & (F.col("least") >= min_class)
    best = F.max(F.when(ok, F.struct(F.round("f1", 12).alias("f1"), (-F.round("risk", 12)).alias("nrisk"), "i")))
    return per.agg(best.alias("b")).select(
        F.coalesce(F.col("b.i") * step, F.lit(0.0)).alias("threshold"), F.coalesce("b.f1", F.lit(-1.0)).alias("f1"))


def fit_drift(df: DataFrame, score: str, weight: Column, truth="truth", pred="raw", min_coverage=0.90,
              min_class=0.75) -> DataFrame:
    """Drift threshold: lowest (risk, -coverage, threshold) among covered candidates.

    Coverage only grows with the threshold, so the coverage rules are one lower
    bound; it comes from one ordered pass per class instead of one per candidate.
    """
    rows = df.select(F.col(truth).alias("truth"), F.col(score).alias("s"), weight.alias("w"),
                     (weight * (F.col(pred) != F.col(truth)).cast("double")).alias("bad"))
    merged = rows.groupBy("truth", "s").agg(F.sum("w").alias("w"), F.sum("bad").alias("bad"))
    merged = merged.withColumns({"band": F.floor(F.col("s") * 1024), "fine": F.floor(F.col("s") * (1 << 20))})
    levels = [["band"], ["band", "fine"]]
    per_class = scan(merged, ["truth"], ["s"], {"cw": running("sum", "w"), "rest": running("sum_after", "w")}, levels)
    floor_class = (per_class.where(F.col("cw") >= F.lit(min_class) * (F.col("cw") + F.col("rest"))).groupBy("truth")
                   .agg(F.min("s").alias("s")).agg(F.max("s").alias("need")))
    flat = merged.groupBy("s", "band", "fine").agg(F.sum("w").alias("w"), F.sum("bad").alias("bad"))
    curve = scan(flat, [], ["s"], {"cw": running("sum", "w"), "cb": running("sum", "bad")}, levels)
    whole = flat.agg(F.sum("w").alias("tw"), F.sum("bad").alias("tb"))
    curve = curve.withColumns({"tw": whole.select("tw").scalar(), "tb": whole.select("tb").scalar(), "need": floor_class.scalar()})
    cand = curve.select("s", "cw", "cb", "tw", "tb", "need")
    ok = (F.col("cw") >= F.lit(min_coverage) * F.col("tw")) & (F.col("s") >= F.col("need"))
    key = F.struct(F.round(F.col("cb") / F.col("cw"), 12).alias("risk"),
                   (-F.round(F.col("cw") / F.col("tw"), 12)).alias("ncov"), F.col("s").alias("s"))
    end = F.struct(F.round(F.max("tb") / F.max("tw"), 12).alias("risk"), F.lit(-1.0).alias("ncov"), F.lit(1.0).alias("s"))
    return cand.agg(F.least(F.min(F.when(ok, key)), end).alias("b")).select(
        F.col("b.s").alias("threshold"), F.col("b.risk").alias("risk"), (-F.col("b.ncov")).alias("coverage"))


def class_weights(df: DataFrame, label: str, weight: Column) -> DataFrame:
    """total / max(count, 1), scaled to mean 1."""
    from pyspark.sql import Window
    per = df.groupBy(F.col(label).alias("label")).agg(F.sum(weight).alias("c"))
    every = Window.partitionBy(F.lit(0))  # one row per class
    raw = per.withColumn("r", F.sum("c").over(every) / F.greatest("c", F.lit(1.0)))
    return raw.select("label", (F.col("r") / F.avg("r").over(every)).alias("class_weight"))


def fit_guard(df: DataFrame, row: str, label: str, features: str, weight: Column) -> DataFrame:
    """Robust envelope per (class, feature): weighted median and spread."""
    from .joins import small
    from .ordered import weighted_medians
    long = df.select(F.col(label).alias("label"), weight.alias("w"), F.posexplode(features).alias("f", "x")).withColumn(
        "x", F.col("x").cast("double"))
    centre = weighted_medians(long, ["label", "f"], "x", "w", "center")
    dev = long.join(small(centre), ["label", "f"]).withColumn("d", F.abs(F.col("x") - F.col("center")))
    mad = weighted_medians(dev, ["label", "f"], "d", "w", "mad")
    rms = dev.groupBy("label", "f").agg(F.max("center").alias("center"),
                                        F.sqrt(F.sum(F.col("w") * F.col("d") * F.col("d")) / F.sum("w")).alias("rms"))
    return rms.join(mad, ["label", "f"]).select("label", "f", "center", F.greatest(
        F.col("mad") * 1.4826, F.col("rms") * 0.1, F.lit(1e-6)).alias("scale"))


def drift_score(df: DataFrame, guard: DataFrame, label: str, features: str) -> DataFrame:
    """1 - exp(-median|z|/4) per row; a class without an envelope scores 1."""
    from .joins import small
    arrays = guard.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("f", "center", "scale"))).alias("g"))
    joined = df.join(small(arrays), df[label] == arrays["label"], "left").drop(arrays["label"])
    z = F.array_sort(F.zip_with(F.col(features), F.col("g"), lambda x, g: F.abs(x.cast("double") - g["center"]) / g["scale"]))
    n = F.size(z)
    mid = (F.get(z, F.floor((n - 1) / 2).cast("int")) + F.get(z, F.floor(n / 2).cast("int"))) / 2
    return joined.withColumn("drift", F.when(F.col("g").isNull(), F.lit(1.0)).otherwise(1 - F.exp(-mid / 4))).drop("g")


def grouped_share(df, keys, cond: Column, name="share") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(cond.cast("double")).alias(name))


def error_rate(edits: Column, length: Column, name="cer") -> Column:
    """Micro-averaged rate in percent; partial sums merge, so it is a plain aggregate."""
    return (F.lit(100.0) * F.sum(edits) / F.sum(length)).alias(name)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "col")]
