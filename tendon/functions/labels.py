"""Label vocabularies and the expressions that read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col

# ---- fixed values: label codes, names and aliases ----
DIRECTIONS = ("none", "forward", "backward", "left", "right", "up", "down")
ARM_WORDS = ("still", "forward", "backward", "left", "right", "up", "down")
GESTURES = ("neutral", "pinch", "fist", "open")
HAND_WORDS = ("neutral", "index_pinch", "fist", "open_hand")
PHASES = ("idle", "onset", "active", "hold", "release", "transition")
CONSISTENCY = ("normal", "atypical")
EVENT_GESTURES = ("index_press", "index_release", "middle_press", "middle_release", "thumb_click",
                  "thumb_down", "thumb_in", "thumb_out", "thumb_up")
GESTURE_ALIASES = {"relax": "neutral", "rest": "neutral", "no movement": "neutral", "hand close": "fist",
                   "close": "fist", "fist": "fist", "hand open": "open", "open": "open", "pinch": "pinch",
                   "pinch grip": "pinch"}
DIRECTION_ALIASES = {"up": "up", "down": "down", "left": "left", "right": "right", "forward": "forward",
                     "backward": "backward", "back": "backward", "relax": "none", "rest": "none"}
ANATOMICAL = {"thumb_tap": "thumb_click", "thumb_swipe_up": "thumb_up", "thumb_swipe_down": "thumb_down"}
FLAGS = ("timestamp_valid", "emg_valid", "imu_valid", "calibrated", "interpolated_imu", "dropped_samples",
         "duplicate_packet", "out_of_order_packet", "quality_gate_failed", "bad_channels", "model_drift",
         "model_disagreement", "low_confidence", "calibration_uncertain")
SPLIT_OF_SESSION = {1: "train", 2: "train", 3: "validation", 4: "test"}
# ------------------------------------------------------


def map_of(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def lookup(pairs: dict, key: Column) -> Column:
    """Value of a fixed map, NULL when the key is absent."""
    return F.try_element_at(map_of(pairs), key)


def split_of(session_no) -> Column:
    return lookup(SPLIT_OF_SESSION, col(session_no).cast("int"))


def session_number(session_id) -> Column:
    """Trailing digits of a session id, NULL unless 1 to 4."""
    n = F.regexp_extract(F.trim(col(session_id)), r"(\d{1,3})$", 1)
    v = F.when(n != "", n.cast("int"))
    return F.when(v.between(1, 4), v)


def code_of(names, c, start=0) -> Column:
    return lookup({n: i + start for i, n in enumerate(names)}, col(c))


def name_of(names, c, missing="unknown") -> Column:
    """Lower-case name of a code; -1 is `missing`."""
    return F.coalesce(lookup(dict(enumerate(names)), col(c).cast("int")), F.lit(missing))


def split_label(label) -> tuple[Column, Column]:
    """Direction and gesture codes of '<arm>_<hand>'; NULL when either part is unknown."""
    pattern = f"^({'|'.join(ARM_WORDS)})_({'|'.join(HAND_WORDS)})$"
    c = col(label)
    arm, hand = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    return code_of(ARM_WORDS, arm), code_of(HAND_WORDS, hand)


def canonical(df: DataFrame, label: str, pairs: dict) -> tuple[DataFrame, DataFrame]:
    """(rows with `canonical`, distinct unmapped labels) by an allow list on trimmed lower-case text."""
    d = df.withColumn("canonical", lookup(pairs, F.lower(F.trim(F.col(label)))))
    return d.where("canonical IS NOT NULL"), d.where("canonical IS NULL").select(label).distinct()


def anatomical_name(name, hand) -> Column:
    n, left = col(name), col(hand) == "left"
    return (F.when(n == "thumb_swipe_left", F.when(left, "thumb_out").otherwise("thumb_in"))
            .when(n == "thumb_swipe_right", F.when(left, "thumb_in").otherwise("thumb_out"))
            .otherwise(F.coalesce(lookup(ANATOMICAL, n), n)))


def quality_flags(conditions: dict[str, Column]) -> Column:
    """Bit mask of named conditions."""
    out = F.lit(0)
    for name, cond in conditions.items():
        out = out.bitwiseOR(F.when(cond, F.lit(1 << FLAGS.index(name))).otherwise(F.lit(0)))
    return out


def flags_valid(flags) -> Column:
    """Timestamp, EMG and IMU bits all set."""
    return col(flags).bitwiseAND(F.lit(7)) == 7
