"""Functions over partitions see whole keys, also behind a join that becomes a broadcast join at run time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tendon.operators import windows
from tendon.runtime import laid


def test_a_key_lies_in_one_task(spark):
    rows = spark.range(2_000_000).select((F.col("id") % 9_000).alias("key"), (F.col("id") % 3).alias("chunk"), F.col("id").alias("n")).localCheckpoint()
    known = rows.select("key", "chunk").distinct().withColumn("entry", F.lit("x")).localCheckpoint()

    def seen(parts):
        yield pd.concat([p[["key", "chunk"]].drop_duplicates() for p in parts]).drop_duplicates()

    found = laid(rows.join(known, ["key", "chunk"]), ["key", "chunk"], ["n"]).mapInPandas(seen, "key bigint, chunk bigint").localCheckpoint()
    assert found.count() == found.distinct().count() == 9_000


def test_means_on_a_threshold_follow_row_order(spark):
    values = [0.9, 0.7, 1.0, 0.6, 0.8, 0.8333333333333334, 0.7666666666666666, 0.8]  # their mean is 0.8, but for the order in which they are added
    d = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n bigint, v double").coalesce(1)
    mean = lambda rows: rows.agg(windows.ordered_mean("v").alias("m"), windows.eligible(F.lit(True), "v", F.lit(False))[2]).first()
    want = 0.0
    for v in values:
        want += v
    found = {tuple(mean(d.orderBy(F.xxhash64("n", F.lit(seed))).coalesce(1))) for seed in range(12)}
    assert found == {(want / 8, want / 8 >= 0.8)}
    assert spark.createDataFrame([(0, None)], "n bigint, v double").agg(windows.ordered_mean("v")).first()[0] is None
