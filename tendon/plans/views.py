"""The driver tables seen as session tables (same definitions as the SQL views)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import block, number_rows, time_slot


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def samples(spark, root) -> DataFrame:
    """One row per sample; trial = user; four signed channels; n is the sample index."""
    e = table(spark, root, "events").select(
        F.col("user_id").alias("trial_id"), (F.col("user_id") % 4 + 1).alias("session_no"), "event_id", "ts",
        "event_type", "value", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        time_slot("ts", 86_400).alias("slot"))
    e = number_rows(e, ["trial_id"], ["ts", "event_id"], "n", [["slot"]])
    v, k = F.col("value") - 50.0, F.col("k")
    return e.select(
        "trial_id", "session_no", "event_id", "ts", "event_type", "k", "n", (F.col("n") * 5).alias("t_ms"),
        v.alias("c0"), (v * (k % 7 - 3) / 3.0).alias("c1"), (v * (k % 5 - 2) / 2.0).alias("c2"),
        (k.cast("double") - 50.0).alias("c3"), block("n").alias("blk"))


def long_samples(spark, root, channels=("c0", "c1", "c2", "c3")) -> DataFrame:
    """samples with one row per (sample, channel)."""
    s = samples(spark, root)
    return s.select("trial_id", "session_no", "event_id", "ts", "event_type", "k", "n", "t_ms", "blk", F.posexplode(
        F.array(*channels)).alias("ch", "x"))


def pred(spark, root) -> DataFrame:
    e = F.slice("embedding", 1, 10)
    q = F.least(F.greatest(F.array_max(e).cast("double"), F.lit(0.0)), F.lit(1.0))
    return table(spark, root, "embeddings").select(
        "vec_id", (F.col("vec_id") % 4 + 1).alias("session_no"), F.floor(F.col("vec_id") / 8).alias("trial_id"),
        F.col("label").alias("truth"),
        F.when(q < 0.15, F.lit(-1)).otherwise(F.array_position(e, F.array_max(e)) - 1).cast("int").alias("pred"),
        q.alias("q"))


def packets(spark, root) -> DataFrame:
    e = table(spark, root, "events").where("event_id % 37 <> 0")
    back = F.when(F.col("event_id") % 41 == 0, F.lit(-1)).otherwise(F.lit(0))
    return e.select(
        (F.col("user_id") % 4 + 1).alias("session_no"),
        F.when(F.col("event_type") == "view", F.lit(2)).otherwise(F.lit(1)).alias("packet_type"), "event_id",
        ((F.col("event_id") + back) % 256).cast("int").alias("packet_seq"))


def trials(spark, root) -> DataFrame:
    return table(spark, root, "orders").select(
        F.col("o_orderkey").alias("trial_id"), (F.col("o_custkey") % 4 + 1).alias("session_no"),
        F.col("o_orderpriority").alias("label"), (F.col("o_orderstatus") != "P").alias("valid"),
        F.col("o_orderdate").alias("start_ts"))


def cues(spark, root) -> DataFrame:
    arm = F.when(F.col("l_linenumber") % 2 == 1, F.lit("arm:")).otherwise(F.lit("hand:"))
    return table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("trial_id"), F.concat(arm, F.col("l_returnflag")).alias("name"),
        F.col("l_shipdate").alias("cue_ts"), F.col("l_linenumber").alias("cue_no"))
