"""Session gate: about 25 rules over the session tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality as Q

# fixed values: protocol limits
EMG_HZ, IMU_HZ, CHANNELS, COMBINATIONS, CUE_TOLERANCE_MS = 250, 112, 8, 28, 80
SPLITS = {"S01": "train", "S02": "train", "S03": "validation", "S04": "test"}
REQUIRED_META = ("tested_arm", "channel1_orientation", "anatomical_marker", "strap_setting", "physical_condition")


def trial_facts(trials: DataFrame, cues: DataFrame, session: str, offsets=(-200, 0, 200), rate: float = EMG_HZ) -> DataFrame:
    """Per session: label, offset, cue and execution facts of the formal trials; one join of trials with their cue row."""
    arm, rel = F.col("name").startswith("arm:"), F.col("name") == "hand:release"
    hand = F.col("name").startswith("hand:") & ~rel
    first = lambda cond: F.min_by(F.struct("emitted_ns", "sample_index"), F.when(cond, F.struct("emitted_ns", "sample_index")))
    c = cues.groupBy("trial_id").agg(first(arm).alias("arm"), first(hand).alias("hand"), F.bool_or(rel).alias("released"))
    t = trials.where("trial_kind = 'formal'").join(c, "trial_id", "left")
    v = F.col("valid")
    has = F.col("arm").isNotNull() & F.col("hand").isNotNull()
    clock = F.abs((F.col("hand.emitted_ns") - F.col("arm.emitted_ns")) / 1e6 - F.col("offset_ms"))
    steps_ms = F.abs((F.col("hand.sample_index") - F.col("arm.sample_index")) * 1000.0 / rate - F.col("offset_ms"))
    per = t.groupBy(session, "label").agg(*[F.count_if(v & (F.col("offset_ms") == o)).alias(f"o{i}") for i, o in enumerate(offsets)], F.count_if(v).alias("n"))
    o = [F.col(f"o{i}") for i in range(len(offsets))]
    lab = per.groupBy(session).agg(F.count(F.lit(1)).alias("labels"), F.min("n").alias("least_trials"),
                                   F.bool_and((F.least(*o) > 0) & (F.greatest(*o) - F.least(*o) <= 1)).alias("balanced"))
    return t.groupBy(session).agg(
        F.count_if(v & ~has).alias("missing_cues"), F.max(F.when(v & has, clock)).alias("max_clock_error"), F.max(F.when(v & has, steps_ms)).alias("max_sample_error"),
        F.count_if(v & F.col("label").endswith("_open_hand") & ~F.coalesce("released", F.lit(False))).alias("missing_release"),
        F.count_if(v & (F.col("completion_status") != "completed")).alias("incomplete"),
        F.count_if(v & ((F.col("stable_start") < 0) | (F.col("stable_end") <= F.col("stable_start")))).alias("no_stable"),
        F.count_if(~v & (F.trim("discard_reason") == "")).alias("unexplained"), F.max("block_index").alias("blocks")).join(lab, session)


def session_gate(meta: DataFrame, trials: DataFrame, cues: DataFrame, blocks: DataFrame, events: DataFrame, audit: DataFrame, session: str,
                 expected_trials: int, expected_blocks, protocol: str, combinations: int = COMBINATIONS) -> tuple[DataFrame, DataFrame]:
    """(rule rows, gate row per session). Each table is reduced to one row per session before they meet."""
    t = trial_facts(trials, cues, session)
    b = blocks.where("valid").groupBy(session).agg(F.collect_set("label").alias("done"))
    e = events.groupBy(session).agg(*[F.count_if(F.col("event_type") == k).alias(n) for k, n in (
        ("BLOCK_BREAK_START", "breaks"), ("FATIGUE_REPORT", "fatigue"), ("QUALITY_ALERT", "alerts"))])
    p = Q.packet_quality(audit, [session])
    f = meta
    for d in (t, b, e, p):
        f = f.join(d, session, "left")
    c = F.col
    need = F.greatest(F.lit(0), F.coalesce("blocks", F.lit(0)) - 1)
    split = F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv])
    near = lambda m, n, share: (F.coalesce(c(m), F.lit(0.0)) == 0) | (F.abs(c(m) - n) / n <= share)
    rules = {
        "schema_version": c("schema_version") == "3.0", "protocol": (c("protocol_name") == protocol) & (c("protocol_version") == protocol),
        "protocol_hash": c("protocol_sha256") != "", "emg_nominal": c("emg_nominal_rate_hz") == EMG_HZ, "imu_nominal": c("imu_nominal_rate_hz") == IMU_HZ,
        "emg_measured": near("measured_emg_rate_hz", EMG_HZ, 0.10), "imu_measured": near("measured_imu_rate_hz", IMU_HZ, 0.15),
        "channels": c("num_emg_channels") == CHANNELS, "metadata": F.size(F.filter(F.array(*REQUIRED_META), lambda x: F.coalesce(F.trim(x), F.lit("")).isin("", "-1"))) == 0,
        "split": c("dataset_split") == F.try_element_at(split, F.upper(c("session_name"))), "model_frozen": (F.upper(c("session_name")) != "S04") | c("model_frozen"),
        "combinations": c("labels") == combinations, "trial_counts": c("least_trials") >= expected_trials, "completed": c("incomplete") == 0, "stable_interval": c("no_stable") == 0,
        "offset_balance": c("balanced"), "cues_present": c("missing_cues") == 0, "cue_clock": F.coalesce("max_clock_error", F.lit(0.0)) <= CUE_TOLERANCE_MS,
        "cue_samples": F.coalesce("max_sample_error", F.lit(0.0)) <= CUE_TOLERANCE_MS, "open_release": c("missing_release") == 0,
        "calibration": F.size(F.array_except(F.array(*[F.lit(x) for x in expected_blocks]), F.coalesce("done", F.array().cast("array<string>")))) == 0,
        "quality_gate": F.coalesce(F.get_json_object("quality_report_json", "$.passed") == "true", F.lit(False)),
        "lost_packets": F.coalesce("lost_ratio", F.lit(0.0)) <= Q.LOST_MAX, "duplicate_packets": F.coalesce("duplicate_ratio", F.lit(0.0)) <= Q.DUPLICATE_MAX,
        "late_packets": F.coalesce("late_ratio", F.lit(0.0)) <= Q.LATE_MAX, "discards_explained": c("unexplained") == 0,
        "breaks": F.coalesce("breaks", F.lit(0)) >= need, "fatigue_reports": F.coalesce("fatigue", F.lit(0)) >= need,
    }
    rows = Q.rule_rows(f, [session], rules)
    return rows, Q.gate(rows, [session]).join(f.select(session, F.coalesce("alerts", F.lit(0)).alias("alerts")), session)
