"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = ("window_features", "a01_emg_features", "a34_calibration_fit", "a21_band_power", "w04_runs", "w10_smooth", "w13_overlap_groups", "w07_debounce",
            "j02_trial_cues", "j04_interval_join", "j06_asof_linear", "j10_greedy_match", "p22_cue_labels", "f01_bandpass", "f03_resample", "f04_spectral_features",
            "a31_threshold_search", "w09_risk_coverage", "t05_state_estimates", "t06_phases", "x01_clean_text", "j19_inventory_diff")


def main():
    from pyspark.sql import SparkSession

    from tendon.plans import QUERIES
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "20g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a08_confusion"](spark, root).write.format("noop").mode("overwrite").save()  # start the JVM paths
    times = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "total time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(root.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
