"""Dataset, session and corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dataset_report(trials: DataFrame, sets, aggs) -> DataFrame:
    """Several groupings in one pass over the trials."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    return trials.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every]).agg(*aggs)


def offset_coverage(trials: DataFrame, keys, offset: str, targets=(-200.0, 0.0, 200.0), tolerance=80.0) -> DataFrame:
    """Missing onset targets per key, as one aggregate row per key."""
    near = [F.bool_or(F.abs(F.col(offset) - t) <= tolerance) for t in targets]
    miss = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(n, F.lit(False)), F.lit(f"{t:g}")) for n, t in zip(near, targets)])), ",")
    return trials.groupBy(*keys).agg(miss.alias("missing_targets"))


def benchmark_stats(df: DataFrame, keys, eligible: Column, stable: Column, unmapped: Column, rate: float) -> DataFrame:
    return df.rollup(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(eligible).alias("eligible"), F.count_if(stable).alias("stable"),
                                (F.count_if(stable) / rate).alias("stable_seconds"), F.avg(unmapped.cast("double")).alias("unmapped_share"))


def repetition_check(df: DataFrame, grid: DataFrame, keys, low=9, high=16) -> DataFrame:
    """Grid cells whose count lies outside the range; absent cells count 0."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    d = grid.join(n, list(keys), "left").select(*keys, F.coalesce("__n", F.lit(0)).alias("repetitions"))
    return d.where(~F.col("repetitions").between(low, high))


def offset_balance(trials: DataFrame, label: str, offset: str, offsets) -> DataFrame:
    """Valid trials per label and offset; balanced when present and within one of each other."""
    n = [F.count_if(F.col("valid") & (F.col(offset) == o)).alias(f"n{i}") for i, o in enumerate(offsets)]
    d = trials.groupBy(label).agg(*n)
    c = [F.col(f"n{i}") for i in range(len(offsets))]
    return d.withColumn("balanced", (F.least(*c) > 0) & (F.greatest(*c) - F.least(*c) <= 1))


def event_counts(events: DataFrame, keys, kind: str, needed: dict[str, int]) -> DataFrame:
    d = events.groupBy(*keys).agg(*[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in needed])
    ok = F.lit(True)
    for k, v in needed.items():
        ok = ok & (F.col(f"n_{k}") >= v)
    return d.withColumn("enough", ok)


def corpus_manifest(corpus: DataFrame, split: str, prompts: str, reason: str) -> DataFrame:
    """Sessions and prompts per split, and skipped sessions per reason."""
    good = corpus.where(F.col(reason) == "").groupBy(F.col(split).alias("part")).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum(prompts).alias("prompts"))
    bad = corpus.where(F.col(reason) != "").groupBy(F.concat(F.lit("skipped:"), reason).alias("part")).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum(prompts).alias("prompts"))
    return good.unionByName(bad)


def qc_summary(events: DataFrame, trial: str, included: str, reasons: str) -> DataFrame:
    """Rows (what, n): trials with every event in, all trials, and one row per reason."""
    per = events.groupBy(trial).agg(F.bool_and(included).alias("ok"))
    a = per.agg(F.count_if("ok").alias("a"), F.count(F.lit(1)).alias("b")).select(F.explode(F.array(
        F.struct(F.lit("trials_included").alias("what"), F.col("a").alias("n")), F.struct(F.lit("trials").alias("what"), F.col("b").alias("n")))).alias("r")).select("r.*")
    b = events.where(F.col(reasons) != "").select(F.explode(F.split(reasons, ",")).alias("what")).groupBy("what").agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


def health(states: DataFrame, run: str, flags: str, direction: str, gesture: str, names) -> DataFrame:
    """Counts, unknown rates and one column per quality flag."""
    return states.groupBy(run).agg(
        F.count(F.lit(1)).alias("states"), F.avg((F.col(direction) == -1).cast("double")).alias("direction_unknown"),
        F.avg((F.col(gesture) == -1).cast("double")).alias("gesture_unknown"),
        *[F.count_if(F.col(flags).bitwiseAND(F.lit(1 << i)) != 0).alias(f"flag_{n}") for i, n in enumerate(names)])
