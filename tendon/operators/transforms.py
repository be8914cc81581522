"""Row transforms: calibration, label rules, sanitising, policy, state records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as N
from ..functions.columns import clamp01, col, roll


def assign_split(session_id, explicit=None) -> Column:
    """Split of a session id; an explicit train/val/test wins; NULL when the id is not 1 to 4."""
    auto = N.split_of(N.session_number(session_id))
    if explicit is None:
        return auto
    said = F.lower(F.trim(col(explicit)))
    return (F.when(said == "val", "validation").when(said.isin("train", "validation", "test"), said).otherwise(auto))


def calibrate_emg(values, center, scale, shift, mode=None, global_scale=None) -> Column:
    """(x - center) / scale per channel or globally, then a circular roll."""
    per = F.zip_with(F.zip_with(col(values), col(center), lambda x, c: x - c), col(scale), lambda d, s: d / s)
    if mode is not None:
        flat = F.transform(F.zip_with(col(values), col(center), lambda x, c: x - c), lambda d: d / col(global_scale))
        per = F.when(col(mode) == "global", flat).otherwise(per)
    return roll(per, col(shift))


def rotate(values, offset, matrix, scale) -> Column:
    """((v - offset) R^T) / scale for three-vectors; R is an array of rows."""
    v, o, m = col(values), col(offset), col(matrix)
    d = [F.get(v, F.lit(i)) - F.get(o, F.lit(i)) for i in range(3)]
    rows = [sum((d[j] * F.get(F.get(m, F.lit(i)), F.lit(j)) for j in range(1, 3)), d[0] * F.get(F.get(m, F.lit(i)), F.lit(0)))
            for i in range(3)]
    return F.array(*[r / col(scale) for r in rows])


def finite(x: Column) -> Column:
    return ~(F.isnan(x) | x.isin(float("inf"), float("-inf")))


def sanitise(df: DataFrame, emg: str, imu: str, quality: str) -> DataFrame:
    """Arithmetic copies with NaN/Inf as 0; raw stays; row and channel flags follow."""
    zero = lambda x: F.when(finite(x), x).otherwise(F.lit(0.0))
    bad = lambda c: F.exists(c, lambda x: ~finite(x))
    return df.withColumns({
        "safe_emg": F.transform(emg, zero), "safe_imu": F.transform(imu, zero),
        "missing": bad(emg) | bad(imu), "imu_valid": ~bad(imu),
        "channel_quality": F.zip_with(F.col(quality), F.col(emg), lambda q, x: F.when(finite(x) & finite(q), clamp01(q)).otherwise(0.0))})


def channel_quality(report, channels: int = 8) -> tuple[Column, Column]:
    """(gate, per-channel 0/1) from a report; no report means gate false and all 0."""
    # fixed values: saturation over 0, zeros over 0.98, mains over 0.35
    schema = "passed boolean, saturation_ratio array<double>, zero_ratio array<double>, mains_50hz_ratio array<double>"
    r = F.from_json(col(report), schema)
    ok = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda i: F.when(
        (F.coalesce(F.get(r["saturation_ratio"], i), F.lit(0.0)) <= 0.0) & (F.coalesce(F.get(r["zero_ratio"], i), F.lit(0.0)) <= 0.98)
        & (F.coalesce(F.get(r["mains_50hz_ratio"], i), F.lit(0.0)) <= 0.35), 1.0).otherwise(0.0))
    blank = col(report).isNull() | (F.trim(col(report)) == "")
    return (F.when(blank, False).otherwise(F.coalesce(r["passed"], F.lit(False))),
            F.when(blank, F.array_repeat(F.lit(0.0), channels)).otherwise(ok))


def effort(level, baseline, active, target: float = 0.85) -> Column:
    return clamp01((col(level) - col(baseline)) / ((col(active) - col(baseline)) / target))


def clean_frames(df: DataFrame, gesture: str, confidence: str, others=(), minimum=0.55) -> DataFrame:
    """Frames with a gesture id 0-8 and finite values; unit range; low confidence means none."""
    d = df.where(F.col(gesture).between(0, 8))
    for c in (confidence, *others):
        d = d.where(finite(F.col(c))).withColumn(c, clamp01(c))
    return d.withColumn(gesture, F.when(F.col(confidence) < minimum, 0).otherwise(F.col(gesture)))


def apply_source_policy(rows: DataFrame, registry: DataFrame, source: str, channels: str, commercial: bool,
                        target_rate: float = 200.0) -> tuple[DataFrame, DataFrame]:
    """(rows per eight-channel domain, refused sources with a reason)."""
    reason = (F.when(F.lit(commercial) & ~F.col("commercial_allowed"), "licence")
              .when(F.col("rate_hz") < target_rate, "lower_rate").when(~F.col("policy").isin("circular_8", "split"), "layout"))
    reg = registry.withColumn("reason", reason)
    good = rows.join(F.broadcast(reg.where("reason IS NULL").select(source, "policy")), source)  # registry: one row per source
    c = F.col(channels)
    parts = F.when(F.col("policy") == "split", F.array(F.slice(c, 1, 8), F.slice(c, 9, 8))).otherwise(F.array(F.slice(c, 1, 8)))
    keep = [x for x in rows.columns if x != channels]
    return good.select(*keep, F.posexplode(parts).alias("domain", channels)), reg.where("reason IS NOT NULL").select(source, "reason")


def project_state(df: DataFrame) -> DataFrame:
    """Sixteen fields in fixed order: names for codes, unit range, -1 for a missing score."""
    return df.select(
        F.col("t_ms").cast("bigint").alias("timestamp_ms"), N.name_of(N.DIRECTIONS, "direction").alias("direction"),
        N.name_of(N.GESTURES, "gesture").alias("gesture"), N.name_of(N.PHASES, "arm_phase").alias("arm_phase"),
        N.name_of(N.PHASES, "hand_phase").alias("hand_phase"), clamp01("activation").alias("activation"),
        clamp01("motion").alias("motion"), N.name_of(N.CONSISTENCY, "consistency").alias("consistency"),
        F.coalesce(clamp_null("score"), F.lit(-1.0)).alias("consistency_score"), clamp01("q_direction").alias("q_direction"),
        clamp01("q_gesture").alias("q_gesture"), clamp01("q_arm").alias("q_arm"), clamp01("q_hand").alias("q_hand"),
        clamp01("emg_quality").alias("emg_quality"), clamp01("imu_quality").alias("imu_quality"), F.col("flags").alias("flags"))


def clamp_null(c) -> Column:
    return F.when(col(c).isNotNull(), clamp01(c))


def project_legacy(df: DataFrame) -> DataFrame:
    """Five fields; unknown and none both become 0."""
    return df.select(F.col("t_ms").cast("bigint").alias("timestamp_ms"), F.greatest(F.lit(0), F.col("direction")).alias("gesture_id"),
                     clamp01("q_direction").alias("q_direction"), clamp01("motion").alias("motion"), clamp01("activation").alias("activation"))


def cue_labels(rows: DataFrame, guard=120.0, active=500.0, settle=150.0) -> DataFrame:
    """Conservative labels per sample from the prompt and cue times on the same row.

    Columns read: t, prompt_from, prompt_to, arm_cue, hand_cue, direction_label,
    gesture_label. A cue is not a movement onset: only the settled part is labelled.
    """
    t, lo, hi = F.col("t"), F.col("prompt_from"), F.col("prompt_to")
    prompt, before, after = (t >= lo) & (t < hi), t < lo, t >= hi
    arm_on = F.col("arm_cue") + guard
    arm_off = F.least(hi, arm_on + active)
    hand_on = F.col("hand_cue") + settle
    still, rest = F.col("direction_label") == 0, F.col("gesture_label") == 0
    yes = lambda c: F.coalesce(c, F.lit(False))
    arm_active = yes(prompt & ~still & (t >= arm_on) & (t < arm_off))
    arm_start = yes(prompt & ~still & (t >= F.col("arm_cue")) & (t < arm_on))
    hand_hold = yes(prompt & ~rest & (t >= hand_on))
    hand_start = yes(prompt & ~rest & (t >= F.col("hand_cue")) & (t < hand_on))
    ph = {n: F.lit(i) for i, n in enumerate(N.PHASES)}
    return rows.withColumns({
        "direction": F.when(before, 0).when(prompt & still, 0).when(arm_active, F.col("direction_label")).otherwise(-1),
        "gesture": F.when(before, 0).when(prompt & rest, 0).when(hand_hold, F.col("gesture_label")).otherwise(-1),
        "arm_phase": F.when(before, ph["idle"]).when(after, ph["release"]).when(prompt & still, ph["hold"])
        .when(arm_start, ph["onset"]).when(arm_active, ph["active"]).otherwise(ph["transition"]),
        "hand_phase": F.when(before, ph["idle"]).when(after, ph["release"]).when(prompt & rest, ph["hold"])
        .when(hand_start, ph["onset"]).when(hand_hold, ph["hold"]).otherwise(ph["transition"]),
        "in_prompt": prompt,
    }).withColumn("stable", F.col("in_prompt") & (F.col("direction") != -1) & (F.col("gesture") != -1))


def augment(df: DataFrame, key: str, arrays: str, seed: int, n: int = 8, drop_share=0.25, noise=0.01) -> DataFrame:
    """Repeatable draws per row: channel roll, amplitude 0.8-1.2, single-channel drop, noise.

    Draws come from a hash of (key, purpose, seed), so a rerun or a lost executor gives the same rows.
    """
    unit = lambda tag: F.pmod(F.xxhash64(F.col(key), F.lit(tag), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    dead = F.when(unit("drop") < drop_share, F.floor(unit("which") * n)).otherwise(F.lit(-1))
    gain = 0.8 + 0.4 * unit("gain")
    x = F.transform(roll(arrays, F.floor(unit("roll") * n).cast("int")), lambda v, i: F.when(i == dead, 0.0).otherwise(
        v * gain + noise * (F.pmod(F.xxhash64(F.col(key), i, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20)) - 0.5)))
    return df.withColumn("augmented", x)


def sample_rules(df: DataFrame, key: str, n: str, t_ms: str, values, quality: str, levels=(), rate=200.0,
                 minimum=40, width=None, width_of=None) -> DataFrame:
    """(key, rule, rows) for every failed sample rule of a trial."""
    from .ordered import exact_quantiles
    from .sequences import difference
    ok = finite(F.col(values[0]))
    for v in values[1:]:
        ok = ok & finite(F.col(v))
    d = difference(df, [key], [n], t_ms, "__step", levels)
    q = F.col(quality)
    facts = d.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~ok).alias("not_finite"), F.count_if(F.col("__step") <= 0).alias("backward"),
        F.count_if(~finite(q) | (q < 0) | (q > 1)).alias("bad_quality"),
        (F.count_if(F.size(width_of) != width) if width_of else F.lit(0).cast("bigint")).alias("bad_width"))
    med = exact_quantiles(d, [key], "__step", {"med": 0.5})
    facts = facts.join(med, key, "left").withColumn("off_rate", (F.abs(1000.0 / F.nullif("med", F.lit(0.0)) - rate) > 0.05 * rate).cast("bigint"))
    failed = F.array(*[F.struct(F.lit(r).alias("rule"), c.alias("rows")) for r, c in (
        ("too_short", F.when(F.col("rows") < minimum, F.col("rows")).otherwise(0)), ("not_finite", F.col("not_finite")),
        ("time_not_increasing", F.col("backward")), ("quality_range", F.col("bad_quality")),
        ("width", F.col("bad_width")), ("rate", F.coalesce("off_rate", F.lit(0))))])
    return facts.select(key, F.explode(F.filter(failed, lambda r: r["rows"] > 0)).alias("r")).select(key, "r.rule", "r.rows")
