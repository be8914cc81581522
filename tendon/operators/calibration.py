"""Per-session calibration fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import small
from .ordered import exact_quantiles

# fixed values: body axes of the guided directions (forward, backward, left, right, up, down)
BODY_VECTORS = {1: (0.0, 1.0, 0.0), 2: (0.0, -1.0, 0.0), 3: (-1.0, 0.0, 0.0), 4: (1.0, 0.0, 0.0), 5: (0.0, 0.0, 1.0), 6: (0.0, 0.0, -1.0)}


def fit_scales(long: DataFrame, session: str, ch: str, x: str, rest: Column) -> DataFrame:
    """Per (session, channel): rest median, gesture P95, rest noise P95, scale; plus the global scale."""
    d = long.withColumn("__rest", rest)
    center = exact_quantiles(d.where("__rest"), [session, ch], x, {"center": 0.5})
    dev = d.join(small(center), [session, ch]).withColumn("__d", F.abs(F.col(x) - F.col("center")))
    per = exact_quantiles(dev, [session, ch, "__rest"], "__d", {"p95": 0.95})
    flat = exact_quantiles(dev, [session, "__rest"], "__d", {"p95": 0.95})
    pick = lambda r, name: F.max(F.when(F.col("__rest") == r, F.col("p95"))).alias(name)
    per = per.groupBy(session, ch).agg(pick(False, "comfortable"), pick(True, "noise"))
    flat = flat.groupBy(session).agg(pick(False, "gc"), pick(True, "gn")).select(
        session, F.greatest(F.col("gc"), F.col("gn") * 3, F.lit(1e-6)).alias("global_scale"))
    return (center.join(per, [session, ch]).join(flat, session)
            .withColumn("scale", F.greatest(F.col("comfortable"), F.col("noise") * 3, F.lit(1e-6))))


def shift_match(profiles: DataFrame, reference: DataFrame, session: str, gesture: str, profile: str, n: int,
                confident=0.10) -> DataFrame:
    """Best circular shift per session over its gestures, its margin, and the shift to apply."""
    unit = lambda a: F.transform(a, lambda v: v / F.greatest(F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, y: s + y * y)), F.lit(1e-12)))
    d = profiles.join(small(reference.withColumnRenamed(profile, "__ref")), gesture)
    d = d.select(session, unit(F.col(profile)).alias("p"), unit(F.col("__ref")).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shift"))
    err = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda s, i: s + F.pow(
        F.get("p", F.pmod(i - F.col("shift"), F.lit(n))) - F.get("q", i), F.lit(2.0))) / n
    e = d.withColumn("e", err).groupBy(session, "shift").agg(F.avg("e").alias("error"))
    rank = Window.partitionBy(session).orderBy(F.round("error", 12), "shift")  # n rows per session
    r = e.withColumn("r", F.row_number().over(rank)).where("r <= 2").groupBy(session).agg(
        F.max(F.when(F.col("r") == 1, F.col("shift"))).alias("candidate"), F.max(F.when(F.col("r") == 1, F.col("error"))).alias("best"),
        F.max(F.when(F.col("r") == 2, F.col("error"))).alias("second"))
    m = F.greatest(F.lit(0.0), (F.col("second") - F.col("best")) / F.greatest(F.col("second"), F.lit(1e-12)))
    return r.withColumn("margin", m).withColumn("shift", F.when(F.col("margin") >= confident, F.col("candidate")).otherwise(F.lit(0)))


def fit_rotation(vectors: DataFrame, session: str, direction: str, axes=("x", "y", "z")) -> DataFrame:
    """Rotation per session from unit direction vectors: 3x3 moments by groupBy, one small solve per session."""
    tgt = vectors.sparkSession.createDataFrame([(d, *v) for d, v in BODY_VECTORS.items()], "d int, t0 double, t1 double, t2 double")
    size = F.sqrt(sum(F.col(a) * F.col(a) for a in axes))
    u = vectors.withColumn("__n", size).where("__n > 1e-9").select(
        session, F.col(direction).cast("int").alias("d"), *[(F.col(a) / F.col("__n")).alias(f"u{i}") for i, a in enumerate(axes)]).join(F.broadcast(tgt), "d")
    mom = u.groupBy(session).agg(F.count(F.lit(1)).alias("m"), *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"xx{i}{j}") for i in range(3) for j in range(3)],
                                 *[F.sum(F.col(f"u{i}") * F.col(f"t{j}")).alias(f"xy{i}{j}") for i in range(3) for j in range(3)]).where("m >= 3")

    def solve(parts):
        for pdf in parts:
            rows = []
            for r in pdf.to_dict("records"):
                xx = np.array([[r[f"xx{i}{j}"] for j in range(3)] for i in range(3)])
                xy = np.array([[r[f"xy{i}{j}"] for j in range(3)] for i in range(3)])
                a, _, b = np.linalg.svd(np.linalg.pinv(xx) @ xy)
                a = a @ np.diag([1.0, 1.0, np.sign(np.linalg.det(a @ b))])
                rows.append({session: r[session], "rotation": [list(map(float, v)) for v in (a @ b).T]})
            yield pd.DataFrame(rows, columns=[session, "rotation"])

    rot = mom.mapInPandas(solve, f"{session} {vectors.schema[session].dataType.simpleString()}, rotation array<array<double>>")
    # residual: mean distance of the rotated unit vectors from their targets
    d = u.join(small(rot), session)
    turned = [sum(F.col(f"u{j}") * F.get(F.get("rotation", F.lit(i)), F.lit(j)) for j in range(3)) - F.col(f"t{i}") for i in range(3)]
    res = d.groupBy(session).agg(F.avg(F.sqrt(sum(t * t for t in turned))).alias("residual"))
    return rot.join(res, session)


def fit_scale(long: DataFrame, keys, x: str, target: float = 16.0) -> DataFrame:
    """median|x| / 16 over all channels; NULL where it is about zero (an error to the caller)."""
    q = exact_quantiles(long.withColumn("__a", F.abs(F.col(x))), keys, "__a", {"m": 0.5})
    return q.select(*keys, F.when(F.col("m") > 1e-12, F.col("m") / target).alias("scale"))


def effort_level(values) -> Column:
    """P75 over channels of the RMS around the channel median; `values` are arrays of a bounded window."""
    from ..functions.columns import let, total
    from ..functions.signal import array_median

    def spread(a):
        return let(array_median(a), lambda m: F.sqrt(total(F.transform(a, lambda y: (y - m) * (y - m))) / F.size(a)))
    ranked = F.array_sort(F.array(*[spread(F.col(v)) for v in values]))
    at = 0.75 * (len(values) - 1)
    lo, share = int(at), at - int(at)
    hi = min(lo + 1, len(values) - 1)
    return let(ranked, lambda r: F.get(r, F.lit(lo)) + (F.get(r, F.lit(hi)) - F.get(r, F.lit(lo))) * share)


def fit_effort(levels: DataFrame, key: str, level: str, phase: str) -> DataFrame:
    """Baseline = median rest level, active = P65 of the active levels, and whether they lie apart enough."""
    rest = exact_quantiles(levels.where(F.col(phase) == "rest"), [key], level, {"baseline": 0.5})
    act = exact_quantiles(levels.where(F.col(phase) == "active"), [key], level, {"active": 0.65})
    d = rest.join(act, key)
    return d.withColumn("usable", F.col("active") - F.col("baseline") >= F.greatest(F.lit(1.0), F.col("baseline") * 0.25))


def fit_consistency(df: DataFrame, keys, a: str, m: str, lag: str, minimum=12) -> DataFrame:
    """Per key with enough rows: medians and covariance (+1e-3 on the diagonal) of (a, m, lag)."""
    v = (a, m, lag)
    cov = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.covar_samp(v[i], v[j]).alias(f"s{i}{j}") for i in range(3) for j in range(i, 3)])
    out = cov.where(F.col("rows") >= minimum).withColumns({f"s{i}{i}": F.col(f"s{i}{i}") + 1e-3 for i in range(3)})
    for i, c in enumerate(v):
        out = out.join(exact_quantiles(df, keys, c, {f"m{i}": 0.5}), list(keys))
    return out


def score_consistency(df: DataFrame, model: DataFrame, keys, a: str, m: str, lag: str, atypical=0.8) -> DataFrame:
    """1 - exp(-d2/2) by the 3x3 inverse written out; NULL without a model or a lag."""
    d = df.join(small(model), list(keys), "left")
    x, y, z = [F.col(c) - F.col(f"m{i}") for i, c in enumerate((a, m, lag))]
    s = {f"{i}{j}": F.col(f"s{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)}
    c00, c11, c22 = s["11"] * s["22"] - s["12"] * s["12"], s["00"] * s["22"] - s["02"] * s["02"], s["00"] * s["11"] - s["01"] * s["01"]
    c01, c02, c12 = s["02"] * s["12"] - s["01"] * s["22"], s["01"] * s["12"] - s["02"] * s["11"], s["01"] * s["02"] - s["00"] * s["12"]
    det = s["00"] * c00 + s["01"] * c01 + s["02"] * c02
    d2 = F.greatest((x * x * c00 + y * y * c11 + z * z * c22 + 2 * (x * y * c01 + x * z * c02 + y * z * c12)) / det, F.lit(0.0))
    score = 1 - F.exp(-0.5 * d2)
    return d.withColumn("score", score).withColumn(
        "consistency", F.when(F.col("score").isNull(), "unknown").when(F.col("score") >= atypical, "atypical").otherwise("normal"))
