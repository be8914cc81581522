"""Response templates, candidate placement and session alignment."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dot
from ..runtime import cut
from . import linking as L
from .folds import grouped_rows
from .joins import small
from .sequences import overlap_groups, peak_quality

# fixed values: ridge 1e-3, at least 3 events
RIDGE, MIN_EVENTS = 1e-3, 3


def global_template(sessions: DataFrame, participant: str, gesture: str, pos: str, value: str, minimum=2) -> DataFrame:
    """Mean of participant means per (gesture, position); gestures with too few participants are left out."""
    per = sessions.groupBy(participant, gesture, pos).agg(F.avg(value).alias("m"))
    return per.groupBy(gesture, pos).agg(F.avg("m").alias("value"), F.count(F.lit(1)).alias("participants")).where(F.col("participants") >= minimum)


def recenter(session: DataFrame, reference: DataFrame, keys, gesture: str, reach=5, least=3) -> DataFrame:
    """Best shift of each session template against the global one by cosine over the overlap; the first wins a tie.

    Both are long (.., o, x array). Row o+shift of the session meets row o of the reference.
    """
    width = session.groupBy(*keys, gesture).agg(F.count(F.lit(1)).alias("w"))
    s = session.select(*keys, gesture, F.col("o").alias("so"), F.col("x").alias("sx"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("shift"))
    d = s.join(small(reference.select(gesture, F.col("o").alias("ro"), F.col("x").alias("rx"))), gesture).where(F.col("so") - F.col("shift") == F.col("ro"))
    vec = lambda c: array_to_vector(c)
    g = d.groupBy(*keys, gesture, "shift").agg(
        F.count(F.lit(1)).alias("m"), F.sum(dot("sx", "rx")).alias("xy"), F.sum(dot("sx", "sx")).alias("xx"), F.sum(dot("rx", "rx")).alias("yy"),
        vector_to_array(Summarizer.sum(vec(F.col("sx")))).alias("a"), vector_to_array(Summarizer.sum(vec(F.col("rx")))).alias("b")).where(F.col("m") >= least)
    size = F.sqrt(F.greatest(F.col("xx") - dot("a", "a") / F.col("m"), F.lit(0.0)) * F.greatest(F.col("yy") - dot("b", "b") / F.col("m"), F.lit(0.0)))
    score = F.when(size > 1e-12, (F.col("xy") - dot("a", "b") / F.col("m")) / size).otherwise(-1.0)
    best = g.withColumn("score", score).groupBy(*keys, gesture).agg(
        F.min_by(F.struct("shift", "score"), F.struct((-F.round("score", 12)).alias("s"), "shift")).alias("b"))
    return width.join(best, [*keys, gesture], "left").select(*keys, gesture, F.coalesce("b.shift", F.lit(0)).alias("shift"), F.col("b.score").alias("score"))


def event_average(frames: DataFrame, events: DataFrame, key: str, offsets: tuple[int, int], minimum=MIN_EVENTS) -> DataFrame:
    """Mean feature vector per (session, class, offset) over events whose whole snippet exists."""
    last = frames.groupBy(key).agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    ok = events.join(small(last), key).where((F.col("center") + offsets[0] >= F.col("lo")) & (F.col("center") + offsets[1] <= F.col("hi")))
    n = ok.groupBy(key, "class").agg(F.count(F.lit(1)).alias("events")).where(F.col("events") >= minimum)
    rows = ok.join(small(n), [key, "class"]).select(key, "class", "events", "center", F.explode(F.sequence(F.lit(offsets[0]), F.lit(offsets[1]))).alias("o"))
    d = rows.withColumn("frame", F.col("center") + F.col("o")).join(frames.select(key, "frame", "x"), [key, "frame"])
    return d.groupBy(key, "class", "o").agg(F.max("events").alias("events"), vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("tpl"))


def fit_templates(frames: DataFrame, events: DataFrame, key: str, offsets: tuple[int, int], ridge=RIDGE, minimum=MIN_EVENTS) -> DataFrame:
    """Overlapping responses by ridge regression with a free intercept: (session, class, o, tpl).

    frames: (key, frame, x); events: (key, class, center). Spark builds the
    normal equations: the design has one entry per (event, offset), pairs of
    entries on one frame come only from events closer than a template, and the
    right-hand side is a vector sum. One task then solves a system whose size is
    classes x offsets, whatever the length of the session.
    """
    width = offsets[1] - offsets[0] + 1
    span = frames.groupBy(key).agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"), F.count(F.lit(1)).alias("rows"),
                                   vector_to_array(Summarizer.sum(array_to_vector("x"))).alias("sx"))
    ev = events.select(key, "class", "center").join(small(span.select(key, "lo", "hi")), key)
    full = ev.where((F.col("center") + offsets[0] >= F.col("lo")) & (F.col("center") + offsets[1] <= F.col("hi")))
    ok = full.groupBy(key, "class").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= minimum).select(key, "class")
    entry = (ev.join(small(ok), [key, "class"]).select(key, "class", "lo", "hi", "center", F.explode(F.sequence(F.lit(offsets[0]), F.lit(offsets[1]))).alias("o"))
             .withColumn("frame", F.col("center") + F.col("o")).where("frame BETWEEN lo AND hi")
             .groupBy(key, "frame", "class", "o").agg(F.sum(F.lit(1.0)).alias("w")))
    a = entry.select(key, "frame", F.col("class").alias("ca"), F.col("o").alias("oa"), F.col("w").alias("wa"))
    b = entry.select(key, "frame", F.col("class").alias("cb"), F.col("o").alias("ob"), F.col("w").alias("wb"))
    gram = a.join(b, [key, "frame"]).groupBy(key, "ca", "oa", "cb", "ob").agg(F.sum(F.col("wa") * F.col("wb")).alias("v"))
    gram = gram.groupBy(key).agg(F.collect_list(F.struct("ca", "oa", "cb", "ob", "v")).alias("gram"))
    rhs = entry.join(frames.select(key, "frame", "x"), [key, "frame"])
    # weights are whole counts, nearly always 1
    rhs = rhs.withColumn("x", F.transform("x", lambda v: v * F.col("w"))).groupBy(key, "class", "o").agg(
        F.sum("w").alias("weight"), vector_to_array(Summarizer.sum(array_to_vector("x"))).alias("sx")).withColumnRenamed("weight", "w")
    rhs = rhs.groupBy(key).agg(F.collect_list(F.struct("class", "o", "w", "sx")).alias("rhs"))
    system = gram.join(rhs, key).join(span.select(key, "rows", "sx"), key)

    def solve(parts):
        for pdf in parts:
            out = []
            for r in pdf.to_dict("records"):
                names = sorted({e["class"] for e in r["rhs"]})
                col = {(c, o): 1 + i * width + (o - offsets[0]) for i, c in enumerate(names) for o in range(offsets[0], offsets[1] + 1)}
                g = np.zeros((1 + len(col), 1 + len(col)))
                y = np.zeros((1 + len(col), len(r["sx"])))
                g[0, 0], y[0] = r["rows"], r["sx"]
                for e in r["gram"]:
                    g[col[e["ca"], e["oa"]], col[e["cb"], e["ob"]]] = e["v"]
                for e in r["rhs"]:
                    j = col[e["class"], e["o"]]
                    g[0, j] = g[j, 0] = e["w"]
                    y[j] = e["sx"]
                g[np.arange(1, len(g)), np.arange(1, len(g))] += ridge
                beta = np.linalg.solve(g, y)
                out += [(r[key], c, o, list(map(float, beta[j]))) for (c, o), j in col.items()]
            yield pd.DataFrame(out, columns=[key, "class", "o", "tpl"])

    kt, ct = frames.schema[key].dataType.simpleString(), events.schema["class"].dataType.simpleString()
    return system.mapInPandas(solve, f"{key} {kt}, class {ct}, o int, tpl array<double>")


def centre_templates(templates: DataFrame, keys) -> DataFrame:
    """Remove the per-feature mean over the offsets of each template."""
    mean = templates.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector("tpl"))).alias("__m"))
    return templates.join(small(mean), list(keys)).withColumn("tpl", F.zip_with("tpl", "__m", lambda a, b: a - b)).drop("__m")


def best_path(cues, scores: np.ndarray, first: int, gap: int) -> list[int]:
    """Delays (from `first` on) of one group of events in cue order, with the largest total score and each event at least `gap` frames behind the one before.

    scores: [events, delays], NaN where there is none. best[j] is the largest total of a placement of all events so far whose
    last one has delay j; the next event may follow any that ends early enough, so it looks up a running maximum. Ties take the
    earlier frame. An event without any score stands at the middle delay for -1; one that no placement leaves room for takes the first delay
    and binds nobody.
    """
    n = scores.shape[1]
    steps, best, low = [], None, 0  # `best` runs over frames from `low`
    for i, cue in enumerate(cues):
        value = scores[i].copy()
        if not np.isfinite(value).any():
            value[(n - 1) // 2] = -1.0
        value[~np.isfinite(value)] = -np.inf
        start = cue + first
        if best is None:
            total, back = value, np.full(n, -1)
        else:
            top = np.maximum.accumulate(best)
            which = np.maximum.accumulate(np.where(np.r_[True, best[1:] > top[:-1]], np.arange(n), 0))
            reach = np.minimum(start + np.arange(n) - gap - low, n - 1)
            total = np.where(reach >= 0, value + top[np.maximum(reach, 0)], -np.inf)
            back = which[np.maximum(reach, 0)]
        if np.isfinite(total).any():
            steps.append((i, back))
            best, low = total, start
    out = [first] * len(cues)
    at = int(np.argmax(best)) if best is not None else 0
    for i, back in reversed(steps):
        out[i] = first + at
        at = int(back[at])
    return out


def place_events(scores: DataFrame, events: DataFrame, key: str, delays: tuple[int, int], gap: int) -> DataFrame:
    """(session, event_id, delay): delays with the largest total score, in order and at least `gap` frames apart.

    Groups of events whose search ranges touch are placed together by `best_path`, exactly and in time linear in the group; a pause
    longer than the search range ends a group, so a group is one stretch of prompts, not a session.
    """
    rows = scores.groupBy(key, "event_id").agg(F.map_from_entries(F.collect_list(F.struct("delay", "score"))).alias("m"))
    ev = events.select(key, "event_id", "cue").join(rows, [key, "event_id"], "left").withColumns({
        "a": F.col("cue") + delays[0], "b": F.col("cue") + delays[1], "slot": F.floor(F.col("cue") / 65_536),
        "s": F.transform(F.sequence(F.lit(delays[0]), F.lit(delays[1])), lambda d: F.try_element_at("m", d))})
    ev = overlap_groups(ev, [key], ["cue", "event_id"], "a", "b", [["slot"]]).select(key, "grp", "event_id", "cue", "s")

    def one(rows):
        table = np.array([[np.nan if v is None else v for v in r["s"]] for r in rows], dtype=float)
        return [(r[key], r["event_id"], d) for r, d in zip(rows, best_path([r["cue"] for r in rows], table, delays[0], gap))]

    kt, it = (events.schema[c].dataType.simpleString() for c in (key, "event_id"))
    return grouped_rows(ev, [key, "grp"], ["cue", "event_id"], one, [key, "event_id", "delay"], f"{key} {kt}, event_id {it}, delay int")


def align_sessions(frames: DataFrame, events: DataFrame, key: str, offsets=(-10, 10), delays=(4, 60), first_delay=22, gap=2,
                   tolerance=0, limit=50, settle=2, reference: DataFrame | None = None, reach=5) -> DataFrame:
    """All sessions at once: templates, scores and placement repeated for each session until its delays stop moving.

    A session whose delays moved by at most `tolerance` has converged; it takes up to `settle` more rounds, until nothing moves, and leaves, so a slow one holds
    back no other. `converged` is false for sessions that still moved by more after `limit` rounds; their last placement is returned. Only the delay per event and the
    settled rounds per session are carried between rounds; they are written to the shared folder, so the plan stays short and survives lost executors.
    Alignment within a session leaves a common shift of a class open. With `reference` (class, o, x), such as `reference_templates`, every session's final templates are
    shifted against it by up to `reach` frames, and `recentred` is the delay after that shift; without it, or for a class that it lacks, the shift is 0.
    Returns (session, event_id, class, cue, delay, score, confidence columns, converged, shift, recentred).
    """
    frames = cut(frames.select(key, "frame", "x"))
    events = cut(events.select(key, "event_id", "class", "cue"))
    width = offsets[1] - offsets[0] + 1
    delay = events.select(key, "event_id", F.lit(first_delay).alias("delay"))
    open_events, open_frames, done = events, frames, []
    settled_rounds = events.select(key).distinct().withColumn("settled", F.lit(0))
    for i in range(limit):
        centers = open_events.join(delay, [key, "event_id"]).withColumn("center", F.col("cue") + F.col("delay"))
        tpl = centre_templates(fit_templates(open_frames, centers, key, offsets), [key, "class"])
        scores = cut(score_own_session(open_events, open_frames, tpl, key, width, delays))
        fresh = cut(place_events(scores, open_events, key, delays, gap))
        moved = cut(fresh.join(delay.withColumnRenamed("delay", "old"), [key, "event_id"]).groupBy(key)
                    .agg(F.max(F.abs(F.col("delay") - F.col("old"))).alias("by")).join(settled_rounds, key)
                    .select(key, "by", F.when((F.col("settled") > 0) | (F.col("by") <= tolerance), F.col("settled") + 1).otherwise(0).alias("settled"))
                    .select(key, "settled", ((F.col("by") > 0) & (F.col("settled") <= settle)).alias("open"), (F.col("settled") > 0).alias("converged")))
        last = i == limit - 1
        settled = (moved if last else moved.where("NOT open")).select(key, "converged")
        took = scores.groupBy(key, "event_id").agg(F.map_from_entries(F.collect_list(F.struct("delay", "score"))).alias("m"))
        done.append(fresh.join(small(settled), key).join(took, [key, "event_id"], "left"))
        still = moved.where("open").select(key)
        settled_rounds = moved.where("open").select(key, "settled")
        if last or still.isEmpty():
            break
        open_events = cut(open_events.join(small(still), key, "left_semi"))
        open_frames = open_frames.join(small(still), key, "left_semi")
        delay = fresh.join(small(still), key, "left_semi")
    d = events.join(reduce(DataFrame.unionByName, done), [key, "event_id"]).withColumn(
        "scores", F.transform(F.sequence(F.lit(delays[0]), F.lit(delays[1])), lambda x: F.coalesce(F.try_element_at("m", x), F.lit(-1.0))))
    d = cut(peak_quality(d, "scores").drop("m", "scores"))
    if reference is None:
        return d.withColumn("shift", F.lit(0)).withColumn("recentred", F.col("delay"))
    own = final_templates(frames, d, key, offsets)
    shifts = recenter(own, reference, [key], "class", reach).select(key, "class", F.col("shift").cast("int").alias("shift"))
    d = d.join(small(shifts), [key, "class"], "left").withColumn("shift", F.coalesce("shift", F.lit(0)))
    return d.withColumn("recentred", F.col("delay") + F.col("shift"))


def final_templates(frames: DataFrame, placed: DataFrame, key: str, offsets) -> DataFrame:
    """(session, class, o, x): the centred templates at the events' final places."""
    centers = placed.select(key, "event_id", "class", (F.col("cue") + F.col("delay")).alias("center"))
    return centre_templates(fit_templates(frames, centers, key, offsets), [key, "class"]).select(key, "class", "o", F.col("tpl").alias("x"))


def reference_templates(templates: DataFrame, key: str, minimum=2) -> DataFrame:
    """(class, o, x): mean over sessions of their templates; a class with fewer sessions than `minimum` is left out."""
    mean = templates.groupBy("class", "o").agg(vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("x"), F.countDistinct(key).alias("n"))
    return mean.where(F.col("n") >= minimum).select("class", "o", "x")




def score_own_session(events, frames, templates, key, width, delays) -> DataFrame:
    """Candidate scores where each session has its own templates."""
    tpl = templates.select(key, "class", "o", "tpl", dot("tpl", "tpl").alias("tt"))
    want = (events.select(key, "event_id", "class", "cue", F.explode(F.sequence(F.lit(delays[0]), F.lit(delays[1]))).alias("delay"))
            .join(small(tpl), [key, "class"]).withColumn("frame", F.col("cue") + F.col("delay") + F.col("o")))
    d = want.join(frames, [key, "frame"])
    g = d.groupBy(key, "event_id", "delay").agg(
        F.count(F.lit(1)).alias("m"), F.sum(dot("tpl", "x")).alias("xy"), F.sum("tt").alias("tt"), F.sum(dot("x", "x")).alias("xx"),
        vector_to_array(Summarizer.sum(array_to_vector("x"))).alias("s")).where(F.col("m") == width)
    size = F.sqrt(F.col("tt") * F.greatest(F.col("xx") - dot("s", "s") / F.col("m"), F.lit(0.0)))
    return g.select(key, "event_id", "delay", F.when(size > 1e-12, F.col("xy") / size).otherwise(-1.0).alias("score"))
