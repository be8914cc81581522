"""Two-head classification with pyspark.ml, scoring, and the per-session output bias."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import argmax, let, margin, softmax
from ..runtime import cut
from .joins import small
from .metrics import class_weights, drift_score

# fixed values: bias limits and steps; rows of a session that one task may hold
MAX_BIAS, LEAST_ROWS, STEPS, RATE, L2 = 0.35, 2, 200, 0.1, 0.5
SESSION_ROWS = 500_000


def fit_head(df: DataFrame, features: str, label: str, weight, iterations=60):
    """Standardised, class-balanced, weighted multinomial model of one head."""
    d = df.select(array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("raw"), F.col(label).cast("double").alias("label"), weight.alias("w0"))
    balance = class_weights(d, "label", F.col("w0"))
    d = d.join(F.broadcast(balance), "label").withColumn("w", F.col("w0") * F.col("class_weight"))  # one row per class
    return Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="std", withMean=True),
                            LogisticRegression(featuresCol="std", labelCol="label", weightCol="w", maxIter=iterations, regParam=1e-3, family="multinomial")]).fit(d)


def head_logits(df: DataFrame, model, features: str, out: str) -> DataFrame:
    d = df.withColumn("raw", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
    return model.transform(d).withColumn(out, vector_to_array("rawPrediction")).drop("raw", "std", "rawPrediction", "probability", "prediction")


def score(df: DataFrame, logits: str, features: str, guard: DataFrame | None, temperature: float, threshold: float, drift_limit: float,
          bias: DataFrame | None = None, session="session_no") -> DataFrame:
    """Class or -1 with confidence, margin and drift; expressions only, so it fuses with the scan."""
    d = df
    z = F.transform(logits, lambda v: v / max(temperature, 1e-4))
    if bias is not None:
        d = d.join(small(bias), session, "left")
        z = F.when(F.col("bias").isNull(), z).otherwise(F.zip_with(z, F.col("bias"), lambda a, b: a + b))
    d = d.withColumn("p", softmax(z)).withColumns({"raw": argmax("p").cast("int"), "q": F.array_max("p"), "margin": margin("p")})
    d = drift_score(d, guard, "raw", features) if guard is not None else d.withColumn("drift", F.lit(0.0))
    bad = (F.col("q") < threshold) | (F.col("drift") > drift_limit)
    return d.withColumns({"confidence_rejected": F.col("q") < threshold, "drift_rejected": F.col("drift") > drift_limit,
                          "pred": F.when(bad, -1).otherwise(F.col("raw"))}).drop("p")


def apply_model(df: DataFrame, fn, schema: str) -> DataFrame:
    """Supplied model over Arrow batches: fn(pandas frame) -> pandas frame. No shuffle."""
    def run(parts):
        for pdf in parts:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def _descend(grad, bias, n):
    bias = bias - RATE * (grad + L2 * bias)
    return np.clip(bias - bias.mean(), -MAX_BIAS, MAX_BIAS)


def fit_bias(df: DataFrame, session: str, logits: str, label: str, classes: int) -> DataFrame:
    """Bounded mean-zero output bias per session that has enough rows of every class.

    Adaptation rows are few, so most sessions are fitted in one task each. A
    session above the row bound is fitted by aggregates instead: one mean
    gradient per step over all executors, the same numbers.
    """
    n = df.groupBy(session).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(label).alias("k"))
    least = df.groupBy(session, label).agg(F.count(F.lit(1)).alias("c")).groupBy(session).agg(F.min("c").alias("least"))
    ok = n.join(least, session).where((F.col("k") == classes) & (F.col("least") >= LEAST_ROWS)).select(session, "rows")
    d = df.select(session, F.transform(logits, lambda v: v.cast("double")).alias("z"), F.col(label).cast("int").alias("y")).join(small(ok), session)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(pdf["z"].to_numpy())
        share = np.bincount(pdf["y"], minlength=classes) / len(pdf)
        bias = np.zeros(classes)
        for _ in range(STEPS):
            e = z + bias
            e = np.exp(e - e.max(axis=1, keepdims=True))
            bias = _descend((e / e.sum(axis=1, keepdims=True)).mean(axis=0) - share, bias, classes)
        return pd.DataFrame({session: [pdf[session].iloc[0]], "bias": [list(map(float, bias))]})

    kt = df.schema[session].dataType.simpleString()
    out = d.where(F.col("rows") <= SESSION_ROWS).groupBy(session).applyInPandas(one, f"{session} {kt}, bias array<double>")
    if ok.where(F.col("rows") > SESSION_ROWS).take(1):
        out = out.unionByName(_fit_large(cut(d.where(F.col("rows") > SESSION_ROWS)), session, classes))
    return out


def _fit_large(d: DataFrame, session: str, classes: int) -> DataFrame:
    idx = F.sequence(F.lit(0), F.lit(classes - 1))
    share = d.groupBy(session).agg(F.array(*[F.avg((F.col("y") == c).cast("double")) for c in range(classes)]).alias("share"))
    state = cut(share.withColumn("bias", F.array_repeat(F.lit(0.0), classes)))
    for step in range(STEPS):
        p = softmax(F.zip_with("z", "bias", lambda a, b: a + b))
        grad = (d.join(small(state), session).withColumn("p", p).groupBy(session)
                .agg(F.array(*[F.avg(F.get("p", F.lit(c))) for c in range(classes)]).alias("mean")))
        moved = F.transform(idx, lambda i: F.get("bias", i) - RATE * (F.get("mean", i) - F.get("share", i) + L2 * F.get("bias", i)))
        clipped = let(moved, lambda b: let(F.aggregate(b, F.lit(0.0), lambda s, v: s + v) / classes, lambda m: F.transform(
            b, lambda v: F.least(F.greatest(v - m, F.lit(-MAX_BIAS)), F.lit(MAX_BIAS)))))
        state = state.join(grad, session).select(session, "share", clipped.alias("bias"))
        state = cut(state) if step % 10 == 9 else state
    return state.select(session, "bias")
