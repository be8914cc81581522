"""Joins of trials, cues, reviews, calibrations and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dot
from .joins import interval_join, small
from .ordered import running, scan


def join_calibration(rows: DataFrame, cal: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their calibration, keys that have none)."""
    side = small(cal)
    missing = rows.select(key).distinct().join(side, key, "left_anti")
    return rows.join(side, key), missing


def cue_columns(cues: DataFrame, trial="trial_id", name="name", order=("cue_no", "cue_ts", "name"), value="cue_ts") -> DataFrame:
    """One row per trial: the last and the first arm and hand cue, and the release cue."""
    arm = F.col(name).startswith("arm:")
    hand = F.col(name).startswith("hand:") & (F.col(name) != "hand:release")
    rel = F.col(name) == "hand:release"
    pick = lambda fn, cond: fn(F.struct(value, name), F.when(cond, F.struct(*order)))
    return cues.groupBy(trial).agg(
        pick(F.max_by, arm).alias("arm_last"), pick(F.max_by, hand).alias("hand_last"),
        pick(F.min_by, arm).alias("arm_first"), pick(F.min_by, hand).alias("hand_first"), pick(F.max_by, rel).alias("release"))


def missing_cues(trials: DataFrame, cues: DataFrame, trial="trial_id") -> DataFrame:
    """(trial, missing kind) for valid trials without an arm or a hand cue."""
    valid = trials.where("valid").select(trial)
    parts = [valid.join(cues.where(F.col("name").startswith(f"{k}:")), trial, "left_anti").withColumn("missing", F.lit(k))
             for k in ("arm", "hand")]
    return parts[0].unionByName(parts[1])


def audit_spans(audit: DataFrame, period: float, recv="recv", lost="lost") -> DataFrame:
    """Time spans spoiled by lost, repeated or late packets."""
    bad = audit.where((F.col(lost) > 0) | F.col("duplicate") | F.col("late"))
    return bad.withColumns({"bad_from": F.col(recv) - F.greatest(F.col(lost), F.lit(1)) * period - period / 2,
                            "bad_to": F.col(recv) + period / 2})


def audit_mask(samples: DataFrame, audit: DataFrame, keys, t: str, period: float) -> DataFrame:
    """Samples inside a spoiled span (semi join: a sample counts once)."""
    spans = audit_spans(audit, period).select(*keys, "bad_from", "bad_to")
    return interval_join(samples, spans, keys, t, "bad_from", "bad_to", width=period * 64, closed=True, how="left_semi")


def active_frames(frames: DataFrame, spans: DataFrame, keys, t: str, start: str, end: str, classes, width: float,
                  closed=False) -> DataFrame:
    """0/1 column per class for every frame; frames outside all spans keep 0."""
    hits = interval_join(frames.select(*keys, t), spans.select(*keys, start, end, "class"), keys, t, start, end, width, closed)
    zero = frames.select(*keys, t, F.lit(None).cast("string").alias("class"))
    return zero.unionByName(hits.select(*keys, t, "class")).groupBy(*keys, t).agg(
        *[F.max((F.coalesce(F.col("class"), F.lit("")) == c).cast("int")).alias(f"is_{c}") for c in classes])


def pulse_spans(events: DataFrame, t: str, first: float, last: float) -> DataFrame:
    """[event+first, event+last)."""
    return events.withColumns({"from_t": F.col(t) + first, "to_t": F.col(t) + last})


def shifted_spans(events: DataFrame, t: str, reference: str, half: float = 20, cue_shift: float = 100) -> DataFrame:
    """Spans of +-half around the event, moved for cue times only."""
    at = F.col(t) + F.when(F.col(reference) == "cue", F.lit(cue_shift)).otherwise(F.lit(0))
    return events.withColumns({"from_t": at - half, "to_t": at + half})


def first_stable(states: DataFrame, onsets: DataFrame, keys, t: str, onset: str, label: str, target: str,
                 limit: float, onset_id: str) -> DataFrame:
    """Time from each onset to the first state with its label within the limit; NULL if there is none."""
    spans = onsets.select(*keys, onset_id, onset, target).withColumn("__to", F.col(onset) + limit)
    hit = interval_join(states.select(*keys, t, label), spans, keys, t, onset, "__to", width=limit, closed=True)
    best = hit.where(F.col(label) == F.col(target)).groupBy(*keys, onset_id).agg(F.min(F.col(t) - F.col(onset)).alias("latency"))
    return onsets.select(*keys, onset_id).join(best, [*keys, onset_id], "left")


def next_release(events, keys, order, t: str, press: Column, release: Column, minimum: float, levels=()) -> DataFrame:
    """Each press with the first later release; `held` when it lasts long enough."""
    d = scan(events, keys, order, {"release_t": running("first_after", F.when(release, F.col(t)))}, levels).where(press)
    return d.withColumn("held", F.coalesce(F.col("release_t") - F.col(t) >= minimum, F.lit(False)))


def press_mask(frames, keys, n: str, press: Column, release: Column, pad: int, levels=()) -> DataFrame:
    """1 from a press up to its next release plus pad; an open press runs to the end.

    The next release grows with the press, so the latest press decides: two
    scans, no range join over spans of unknown length.
    """
    d = scan(frames, keys, [n], {"__r": running("first_after", F.when(release, F.col(n)))}, levels)
    until = F.when(press, F.coalesce(F.col("__r") + pad, F.lit(2 ** 62)))
    d = scan(d.withColumn("__until", until), keys, [n], {"__u": running("last", "__until")}, levels)
    return d.withColumn("mask", F.coalesce(F.col(n) < F.col("__u"), F.lit(False)).cast("int")).drop("__r", "__until", "__u")


def count_gap(trials: DataFrame, protocol: DataFrame, label="label") -> DataFrame:
    """Declared labels with their valid count and shortfall."""
    have = trials.where("valid").groupBy(label).agg(F.count(F.lit(1)).alias("have"))
    return protocol.join(have, label, "left").select(
        label, "expected", F.coalesce("have", F.lit(0)).alias("have"),
        F.greatest(F.col("expected") - F.coalesce("have", F.lit(0)), F.lit(0)).alias("shortfall"))


def leakage(rows: DataFrame, group: str, split: str, splits=("train", "validation", "test")) -> DataFrame:
    """Groups in several splits, and declared splits without rows."""
    per = rows.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("s"), F.count(F.lit(1)).alias("rows"))
    several = per.where(F.size("s") > 1).select(F.lit("group_in_several_splits").alias("rule"),
                                                F.col(group).cast("string").alias("subject"), F.array_join("s", ",").alias("detail"))
    names = rows.sparkSession.createDataFrame([(s,) for s in splits], f"{split} string")
    empty = names.join(rows.select(split).distinct(), split, "left_anti").select(
        F.lit("empty_split").alias("rule"), F.col(split).alias("subject"), F.lit("").alias("detail"))
    return several.unionByName(empty)


def reviewed_prompts(events: DataFrame, reviews: DataFrame, accepted, trial="trial_id", event="event_no") -> DataFrame:
    """Events of trials whose every review is accepted, at the reviewed index."""
    ok = reviews.groupBy(trial).agg(F.bool_and(F.col("status").isin(*accepted)).alias("ok")).where("ok")
    return events.join(reviews, [trial, event]).join(ok.select(trial), trial, "left_semi")


def apply_reviews(reviews: DataFrame, changes: DataFrame, length: int, trial="trial_id", event="event_no") -> DataFrame:
    """Reviews after the latest change per event; a change without an event applies to its whole trial."""
    step = F.struct("change_no", "status", "index")
    per_event = changes.where(F.col(event).isNotNull()).groupBy(trial, event).agg(F.max_by(step, "change_no").alias("__e"))
    per_trial = changes.where(F.col(event).isNull()).groupBy(trial).agg(F.max_by(step, "change_no").alias("__t"))
    index = changes.where(F.col(event).isNotNull() & F.col("index").isNotNull()).groupBy(trial, event).agg(
        F.max_by("index", "change_no").alias("__i"))
    d = reviews.join(per_event, [trial, event], "left").join(index, [trial, event], "left").join(per_trial, trial, "left")
    last = F.when(F.coalesce(F.col("__t.change_no"), F.lit(-1)) > F.coalesce(F.col("__e.change_no"), F.lit(-1)), F.col("__t.status")) \
        .otherwise(F.col("__e.status"))
    at = F.least(F.greatest(F.coalesce("__i", "index"), F.lit(0)), F.lit(max(0, length - 1)))
    return d.select(trial, event, F.coalesce(last, F.col("status")).alias("status"), at.alias("index"))


# fixed values: sessions that must exist before a session
PREREQUISITES = {3: (2,), 4: (1, 2, 3)}


def prerequisites(df: DataFrame, participant: str, session: str) -> DataFrame:
    """(participant, session, missing earlier sessions)."""
    have = df.groupBy(participant).agg(F.collect_set(F.col(session).cast("int")).alias("have"))
    need = F.array(*[F.struct(F.lit(s).alias("session"), F.array(*[F.lit(x) for x in req]).alias("req"))
                     for s, req in PREREQUISITES.items()])
    out = have.select(participant, "have", F.explode(need).alias("r")).where(F.array_contains("have", F.col("r.session")))
    return out.select(participant, F.col("r.session").alias("session"),
                      F.array_join(F.array_sort(F.array_except("r.req", "have")), ",").alias("missing")).where("missing <> ''")


def inventory_diff(local: DataFrame, remote: DataFrame, key="path", digest="digest") -> DataFrame:
    """same, changed, new (local only) or missing (remote only) per path."""
    d = local.select(key, F.col(digest).alias("__l")).join(remote.select(key, F.col(digest).alias("__r")), key, "full_outer")
    state = (F.when(F.col("__r").isNull(), "new").when(F.col("__l").isNull(), "missing")
             .when(F.col("__l") == F.col("__r"), "same").otherwise("changed"))
    return d.select(key, state.alias("state"))


def score_candidates(events: DataFrame, frames: DataFrame, templates: DataFrame, key: str, width: int,
                     delays: tuple[int, int]) -> DataFrame:
    """Cosine of the class template with the snippet at every (event, delay).

    templates: (class, o, tpl array) with per-feature mean over o removed.
    frames: (key, frame, x array); events: (key, event_id, class, cue).
    Each event makes delays x offsets small rows that meet frames on (key, frame);
    only complete snippets are kept. A removed mean in the template removes it
    from the product, so the snippet mean is needed for its length only.
    """
    tpl = templates.select("class", "o", "tpl", dot("tpl", "tpl").alias("tt"))
    want = (events.select(key, "event_id", "class", "cue", F.explode(F.sequence(F.lit(delays[0]), F.lit(delays[1]))).alias("delay"))
            .join(small(tpl), "class").withColumn("frame", F.col("cue") + F.col("delay") + F.col("o")))
    d = want.join(frames.select(key, "frame", "x"), [key, "frame"])
    total = F.aggregate(F.collect_list("x"), F.array_repeat(F.lit(0.0), F.size(F.first("x"))),
                        lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    g = d.groupBy(key, "event_id", "class", "delay").agg(
        F.count(F.lit(1)).alias("m"), F.sum(dot("tpl", "x")).alias("xy"), F.sum("tt").alias("tt"),
        F.sum(dot("x", "x")).alias("xx"), total.alias("s"))
    g = g.where(F.col("m") == width)
    size = F.sqrt(F.col("tt") * F.greatest(F.col("xx") - dot("s", "s") / F.col("m"), F.lit(0.0)))
    return g.select(key, "event_id", "delay", F.when(size > 1e-12, F.col("xy") / size).otherwise(-1.0).alias("score"))


def snippets(samples: DataFrame, events: DataFrame, keys, t: str, at: str, before: float, after: float, width: float) -> DataFrame:
    """Samples in [-before, +after] around each event, with their offset."""
    spans = events.withColumns({"__from": F.col(at) - before, "__to": F.col(at) + after})
    d = interval_join(samples, spans, keys, t, "__from", "__to", width, closed=True)
    return d.withColumn("offset", F.col(t) - F.col(at)).drop("__from", "__to")


def invalidate(trials: DataFrame, alerts: DataFrame, keys, start: str, end: str, t: str, reason: str, width: float) -> DataFrame:
    """Valid trials with an alert inside become invalid; the first reason by time stays."""
    hit = interval_join(alerts.select(*keys, t, reason), trials.select(*keys, "trial_id", start, end), keys, t, start, end, width, closed=True)
    first = hit.groupBy("trial_id").agg(F.min_by(reason, F.struct(t, reason)).alias("why"))
    d = trials.join(first, "trial_id", "left")
    return d.withColumns({"reason": F.when(F.col("valid"), F.col("why")), "valid": F.col("valid") & F.col("why").isNull()}).drop("why")
