"""One-row evaluation report and its run-once lock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import r6
from . import metrics as M

# fixed values: acceptance limits
TARGET_F1, TARGET_JOINT, TARGET_P95_MS = 0.85, 0.75, 300.0


def evaluation_row(df: DataFrame, weight: Column, latency: DataFrame | None = None, q1="q", q2="q") -> DataFrame:
    """F1, joint accuracy, coverage, calibration error and target flag; every part is a one-row frame."""
    parts = [
        M.macro_f1(df, weight=weight).select(r6("macro_f1", "f1_1")),
        M.macro_f1(df, "truth2", "pred2", weight=weight).select(r6("macro_f1", "f1_2")),
        M.joint_accuracy(df, weight).select(*[r6(c, c) for c in ("joint_accuracy", "coverage_1", "coverage_2")]),
        M.ece(df, q1, weight).select(r6("ece", "ece_1")),
        M.ece(df, q2, weight, truth="truth2", pred="pred2").select(r6("ece", "ece_2")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.withColumns({c: p.select(c).scalar() for c in p.columns})
    if latency is None:
        out = out.withColumn("p95_latency_ms", F.lit(None).cast("double"))
    else:
        out = out.withColumn("p95_latency_ms", latency.select("p95_latency_ms").scalar())
    meets = ((F.col("f1_1") >= TARGET_F1) & (F.col("f1_2") >= TARGET_F1) & (F.col("joint_accuracy") >= TARGET_JOINT)
             & F.coalesce(F.col("p95_latency_ms") <= TARGET_P95_MS, F.lit(False)))
    return out.withColumn("meets_target", meets)


def evaluate_once(df: DataFrame, weight: Column, path: str) -> DataFrame:
    """Evaluate the test split and lock it: a second run fails because the result exists."""
    evaluation_row(df, weight).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
