"""The classifier heads beside the logistic one: a kernel machine over random Fourier features, and linear discriminants from sums."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a task when a kernel machine is fitted, and machines that are fitted at once; each keeps its own blocks of the rows in memory, or on disk.
TASK_ROWS = 25_000
MACHINES = 8


def moments(df: DataFrame, features: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(label, n, mean array) per class and (i, j, value), the covariance inside classes, over rows minus classes.

    Every Arrow batch gives one row of sums per class and one of products, which are added by Spark; what is added is batches x width^2 numbers, not rows.
    Products are taken around the first row of a batch's class, so large offsets do not cancel digits.
    """
    kind = df.schema[label].dataType.simpleString()

    def run(parts):
        for pdf in parts:
            made = []
            for c, rows in pdf.groupby("c"):
                x = np.stack(rows["x"].to_numpy()).astype(float)
                mean = x.mean(axis=0)
                made.append((c, len(x), x.sum(axis=0), ((x - mean).T @ (x - mean)).ravel()))
            yield pd.DataFrame(made, columns=["c", "n", "total", "inside"])

    d = df.select(F.col(label).alias("c"), F.transform(features, lambda v: v.cast("double")).alias("x")).where(F.col("c").isNotNull())
    parts = d.mapInPandas(run, f"c {kind}, n bigint, total array<double>, inside array<double>")
    n = parts.groupBy("c").agg(F.sum("n").alias("n"))
    total = parts.select("c", F.posexplode("total")).groupBy("c", "pos").agg(F.sum("col").alias("v")).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("t"))
    means = n.join(total, "c").select("c", "n", F.transform("t", lambda t: t["v"] / F.col("n")).alias("mean"))
    # products around the mean of a batch become products around the mean of the class: add n (batch mean - class mean)(...)'
    off = parts.join(means.select("c", "mean"), "c").select(F.zip_with("total", "mean", lambda s, m: s / F.col("n") - m).alias("o"), "n", "inside")
    size = F.size("o")
    full = F.transform("inside", lambda v, k: v + F.col("n") * F.element_at("o", F.floor(k / size).cast("int") + 1) * F.element_at("o", (k % size).cast("int") + 1))
    width = off.select(size.alias("d")).agg(F.max("d").alias("d"))
    freedom = means.agg((F.sum("n") - F.count(F.lit(1))).alias("f"))
    summed = off.select(F.posexplode(full)).groupBy("pos").agg(F.sum("col").alias("s"))
    d_, f_ = width.select("d").scalar(), freedom.select("f").scalar()
    covariance = summed.select(F.floor(F.col("pos") / d_).cast("int").alias("i"), (F.col("pos") % d_).cast("int").alias("j"), (F.col("s") / f_).alias("value"))
    return means.withColumnRenamed("c", label), covariance


@dataclass(frozen=True)
class Discriminant:
    """z = weights @ x + offset per class."""

    classes: list
    weights: np.ndarray
    offset: np.ndarray

    def logits(self, df: DataFrame, features: str, out: str) -> DataFrame:
        """`df` with the classes' scores as an array, by expressions only."""
        def score(w, b):
            return F.aggregate(F.zip_with(features, F.array(*[F.lit(float(v)) for v in w]), lambda a, c: a.cast("double") * c), F.lit(float(b)), lambda s, v: s + v)
        return df.withColumn(out, F.array(*[score(w, b) for w, b in zip(self.weights, self.offset, strict=True)]))


def fit_discriminant(df: DataFrame, features: str, label: str, ridge: float = 1e-6) -> Discriminant:
    """Linear discriminants: class means and one covariance come from Spark (classes x width and width^2 numbers), the small system is solved here."""
    means, covariance = moments(df, features, label)
    rows = sorted(means.collect(), key=lambda r: r[label])
    m, n = np.array([r["mean"] for r in rows]), np.array([r["n"] for r in rows], dtype=float)
    cov = np.zeros((m.shape[1], m.shape[1]))
    for r in covariance.collect():
        cov[r.i, r.j] = r.value
    cov += ridge * max(np.trace(cov) / len(cov), 1e-12) * np.eye(len(cov))
    w = np.linalg.solve(cov, m.T).T
    return Discriminant([r[label] for r in rows], w, -0.5 * (w * m).sum(axis=1) + np.log(n / n.sum()))


@dataclass(frozen=True)
class Fourier:
    """Seeded random features whose inner product tends to the kernel exp(-gamma |x - y|^2)."""

    size: int = 256
    gamma: float = 0.5
    seed: int = 3

    def of(self, x: pd.Series) -> np.ndarray:
        """The features of a batch of rows, [rows, size]."""
        a = np.stack(x.to_numpy()).astype(float)
        rng = np.random.default_rng(self.seed)
        w = rng.normal(scale=np.sqrt(2 * self.gamma), size=(a.shape[1], self.size))
        return np.cos(a @ w + rng.uniform(0, 2 * np.pi, self.size)) * np.sqrt(2.0 / self.size)

    def map(self, df: DataFrame, features: str, out: str) -> DataFrame:
        """`df` with `out`, an array of `size` features; batches of rows, no shuffle."""
        of = self.of

        @F.pandas_udf("array<double>")
        def lifted(x: pd.Series) -> pd.Series:
            return pd.Series(list(of(x)))

        return df.withColumn(out, lifted(F.transform(features, lambda v: v.cast("double"))))


@dataclass(frozen=True)
class KernelHead:
    """One machine per class over the lifted features."""

    lift: Fourier
    model: object

    def logits(self, df: DataFrame, features: str, out: str) -> DataFrame:
        """`df` with the machines' margins as an array: lifted and weighed in one call a batch, not by one Python function per class."""
        of, weights = self.lift.of, np.stack([m.coefficients.toArray() for m in self.model.models])
        offset = np.array([m.intercept for m in self.model.models])

        @F.pandas_udf("array<double>")
        def margins(x: pd.Series) -> pd.Series:
            return pd.Series(list(of(x) @ weights.T + offset))

        return df.withColumn(out, margins(F.transform(features, lambda v: v.cast("double"))))


def dealt(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """`df` in partitions of about `rows` rows, so that the tasks of a pass follow the rows, not the files."""
    parts = max(1, -(-df.count() // rows))
    return df.coalesce(parts) if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def fit_kernel_head(df: DataFrame, features: str, label: str, weight: str | None = None, lift: Fourier | None = None, iterations: int = 50, penalty: float = 1e-4) -> KernelHead:
    """A support vector machine with a Gaussian kernel, by random Fourier features and one linear machine per class (labels 0, 1, ...).

    A machine takes two passes or more per iteration, each a short job, so their number and not the rows set the time: MACHINES are fitted at once, over partitions that follow the rows.
    """
    lift = lift or Fourier()
    source = dealt(df.select(features, label, *([weight] if weight else [])))
    d = lift.map(source, features, "__lift").select(array_to_vector("__lift").alias("__v"), F.col(label).cast("double").alias("label"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    svm = LinearSVC(featuresCol="__v", maxIter=iterations, regParam=penalty)
    return KernelHead(lift, OneVsRest(classifier=svm, featuresCol="__v", labelCol="label", weightCol="w", predictionCol="__guess", parallelism=MACHINES).fit(d))
