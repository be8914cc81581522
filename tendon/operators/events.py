"""Event decoding from probability frames and event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp01
from ..runtime import cut
from . import sequences as S
from . import steps
from .folds import blended, by_row, chunked_fold
from .joins import small
from .jumps import CHUNK_ROWS, first_reaching, orbit
from .ordered import index, number_rows, running, scan


def debounce(events: DataFrame, keys, chunk: str, gap, releases=steps.RELEASES, older=False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Kept events, by `steps.debounce`. Columns name and t are read; `chunk` follows t.

    After a kept event the next is the first one `gap` later, or a release of another name before it (with `older`, after a release also the first event that is none).
    """
    keys, releases = list(keys), list(releases)
    d = number_rows(events.select(*keys, chunk, "t", "name"), keys, ["t", "name"], "n", [[chunk]])
    if gap <= 0:
        return d.select(*keys, "t", "name")
    n = F.col("n")
    after = {f"__r{i}": running("first_after", F.when(F.col("name") == r, n)) for i, r in enumerate(releases)}
    if older:
        after["__other"] = running("first_after", F.when(~F.coalesce(F.col("name").isin(*releases), F.lit(False)), n))
    d = scan(d, keys, ["n"], after, [[chunk]]) if after else d
    d = cut(d)
    d = first_reaching(d, keys, "t", "n", F.col("t") + gap, gap * 256.0, "__late")
    near = [F.when(F.coalesce(F.col("name") != r, F.lit(True)), F.col(f"__r{i}")) for i, r in enumerate(releases)]
    if older:
        near.append(F.when(F.col("name").isin(*releases), F.col("__other")))
    found = [F.col("__late"), *near]
    d = d.withColumn("next", F.least(*found) if len(found) > 1 else found[0])
    return orbit(d.select(*keys, "n", "next", "t", "name"), keys, chunk_rows).where("kept").select(*keys, "t", "name")


def merge_prompts(prompts: DataFrame, keys, chunk: str, minimum: float, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Following prompts joined until their length reaches the minimum; the rest is kept. Reads n, len (not negative), text, start, end; `chunk` follows n.

    A merged prompt that begins at a row ends where the running length has grown by the minimum, so the next one begins behind that row. A row without length at its head stands alone.
    """
    keys = list(keys)
    d = scan(prompts.select(*keys, chunk, F.col("n").alias("__own"), "len"), keys, ["__own"], {"n": index(), "__sum": running("sum", "len")}, [[chunk]])
    d = cut(d.select(*keys, chunk, "__own", "n", "len", "__sum", (F.col("__sum") - F.col("len") + minimum).alias("__until")))
    d = first_reaching(d, keys, "__sum", "n", F.col("__until"), max(1.0, float(minimum)) * 256.0, "__last")
    last = F.when(F.col("len") == 0, F.col("n")).otherwise(F.greatest("__last", "n"))  # a minimum of zero is reached at once
    d = d.withColumn("next", F.when((F.col("len") == 0) | F.col("__last").isNotNull(), last + 1))
    marked = orbit(d.select(*keys, "n", "next", chunk, "__own"), keys, chunk_rows)
    tag = scan(marked, keys, ["n"], {"first": running("last", F.when(F.col("kept"), F.col("__own")))}, [[chunk]]).select(*keys, F.col("__own").alias("n"), "first")
    d = prompts.join(tag, [*keys, "n"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda s: s["text"]), "")
    return d.groupBy(*keys, "first").agg(text.alias("text"), F.min("start").alias("start"), F.max_by("end", "n").alias("end"), F.sum("len").alias("len"))


def sequence_audit(packets: DataFrame, keys, chunk: str) -> DataFrame:
    """lost_before, duplicate and late per packet. Reads t (arrival order) and seq."""
    run = by_row(steps.sequence_audit, ("t", "lost_before", "duplicate", "late"))
    return chunked_fold(packets.select(*keys, chunk, "t", "seq"), keys, ["t"], chunk, run, None,
                        "t bigint, lost_before int, duplicate boolean, late boolean")


def match_events(pred: DataFrame, truth: DataFrame, keys, t: str, tolerance, slot: Column) -> DataFrame:
    """(keys, pred_t, truth_t): greedy nearest matching in prediction order."""
    rows = (truth.select(*keys, F.col(t).alias("t"), F.lit(0).alias("side"))
            .unionByName(pred.select(*keys, F.col(t).alias("t"), F.lit(1).alias("side"))))
    end = rows.groupBy(*keys).agg((F.max("t") + tolerance + 1).alias("t")).withColumn("side", F.lit(2))
    rows = rows.unionByName(end).withColumn("slot", slot)
    run = by_row(steps.greedy_match(tolerance), ("pred_t", "truth_t"))
    return chunked_fold(rows, keys, ["t", "side"], "slot", run, [[], []], "pred_t bigint, truth_t bigint")


def match_counts(matches: DataFrame, pred: DataFrame, truth: DataFrame, keys) -> DataFrame:
    """tp, fp, fn and mean signed latency per key."""
    m = matches.groupBy(*keys).agg(F.count("truth_t").alias("tp"), F.count_if(F.col("truth_t").isNull()).alias("fp"),
                                   F.avg(F.col("pred_t") - F.col("truth_t")).alias("latency"))
    n = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("truths"))
    return n.join(m, keys, "full_outer").fillna(0, ["tp", "fp", "truths"]).withColumn("fn", F.col("truths") - F.col("tp"))


def event_metrics(counts: DataFrame, cls: str, minutes: DataFrame | None = None) -> DataFrame:
    """Per class precision, recall, F1, FNR; the row with class NULL holds macro and micro F1 and false positives per minute."""
    per = counts.groupBy(cls).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))
    r = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    per = per.withColumns({"precision": p, "recall": r, "fnr": F.col("fn") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))})
    per = per.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-12), F.col("precision") + F.col("recall")))
    whole = per.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.avg("f1").alias("macro_f1")).withColumns({
        "precision": F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), "recall": F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))})
    whole = whole.withColumns({"f1": 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-12), F.col("precision") + F.col("recall")),
                               "fnr": F.col("fn") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")), cls: F.lit(None).cast(counts.schema[cls].dataType)})
    if minutes is not None:
        whole = whole.withColumn("fp_per_minute", F.col("fp") / F.greatest(F.lit(1e-12), minutes.select("minutes").scalar()))
        per = per.withColumn("fp_per_minute", F.lit(None).cast("double"))
    return per.withColumn("macro_f1", F.lit(None).cast("double")).unionByName(whole)


def threshold_events(frames: DataFrame, keys, frame: str, cls: str, p: str, threshold: Column, gap, chunk_rows=65_536,
                     releases=steps.RELEASES, levels=(), order_of: Column | None = None) -> DataFrame:
    """Rising edges per class, one winner per frame, then debouncing. `frames` is long (key, frame, class, p)."""
    e = S.rising_edges(frames, [*keys, cls], [frame], p, threshold, levels)
    rank = order_of if order_of is not None else F.col(cls)
    e = e.select(*keys, frame, cls, p, rank.alias("__rank"))
    w = S.arbitrate(e, [*keys, frame], p, "__rank")
    w = w.select(*keys, F.col(frame).alias("t"), F.col(cls).alias("name"), F.floor(F.col(frame) / chunk_rows).alias("__chunk"))
    return debounce(w, keys, "__chunk", gap, releases)


def press_release(events: DataFrame, keys, chunk: str, minimum) -> DataFrame:
    """Presses paired with releases. Only the row before matters: a press there is closed by its own release or, by any other event, with a synthetic one."""
    keys = list(keys)
    d = scan(events.select(*keys, chunk, "t", "name"), keys, ["t", "name"], {"__p": running("lag", F.struct("name", "t"))}, [[chunk]])
    press, release = lambda c: c.isin(*steps.PRESS_TO_RELEASE), F.col("name").isin(*steps.RELEASES)
    want = F.element_at(F.create_map(*[F.lit(x) for p in steps.PRESS_TO_RELEASE.items() for x in p]), F.when(press(F.col("__p.name")), F.col("__p.name")))
    held = F.greatest(F.lit(0).cast("bigint"), F.col("t") - F.col("__p.t"))
    row = lambda name, synthetic, h, ok: F.struct(F.col("t"), name.alias("name"), F.lit(synthetic).alias("synthetic"), h.cast("bigint").alias("held"), ok.cast("boolean").alias("hold_ok"))
    closed = F.when(want.isNotNull() & (F.col("name") == want), row(F.col("name"), False, held, held >= minimum)).when(
        want.isNotNull(), row(want, True, held, F.lit(False)))
    own = F.when(~release, row(F.col("name"), False, F.lit(None), F.lit(None)))
    return d.select(*keys, F.explode(F.filter(F.array(closed, own), lambda x: x.isNotNull())).alias("o")).select(*keys, "o.*")


def phases(frames: DataFrame, keys, chunk: str, open_label: int | None = None, **kw) -> DataFrame:
    step = steps.phase_tracker(**kw) if open_label is None else steps.open_tracker(open_label=open_label, **kw)
    start = [0, 0, 0, 0] if open_label is None else [[0, 0, 0, 0], 0]
    return chunked_fold(frames.select(*keys, chunk, "n", "label"), keys, ["n"], chunk, by_row(step, ("n", "stable", "phase")), start,
                        "n bigint, stable int, phase int")


def gesture_events(frames: DataFrame, keys, chunk: str, stable_ms=120) -> DataFrame:
    """Enter, hold and exit events. Reads t, id, gesture.

    The fold gives the stable gesture per frame; how long it lasted comes from
    a scan for the last change, so a long hold does not tie chunks together.
    """
    run = by_row(steps.gesture_frames(stable_ms), ("t", "id", "gesture", "left"))
    d = chunked_fold(frames.select(*keys, chunk, "t", "id", "gesture"), keys, ["t", "id"], chunk, run, steps.GESTURE_START,
                     "t bigint, id bigint, gesture int, left int")
    d = d.withColumn("__slot", F.floor(F.col("t") / F.lit(max(1, stable_ms) * 512)))
    d = scan(d, keys, ["t", "id"], {"__since": running("last_before", F.when(F.col("left").isNotNull(), F.col("t")))}, [["__slot"]])
    held = F.greatest(F.lit(0).cast("bigint"), F.col("t") - F.coalesce("__since", F.lit(0)))
    ev = lambda kind, g, h: F.struct(F.lit(kind).alias("kind"), g.alias("gesture"), h.cast("bigint").alias("held"))
    change = F.array(ev("exit", F.col("left"), held), ev("enter", F.col("gesture"), F.lit(0)))
    one = F.array(ev("hold", F.col("gesture"), held))
    return d.select(*keys, "t", F.explode(F.when(F.col("left").isNull(), one).otherwise(change)).alias("e")).select(*keys, "t", "e.*")


def timeouts(frames: DataFrame, keys, order, t: str, gesture: str, limit, levels=()) -> DataFrame:
    """Forced 'none' times: the frame before a silence of at least the limit, unless it was none already."""
    d = scan(frames, keys, order, {"__next": running("lead", t)}, levels)
    silent = F.col("__next").isNull() | (F.col("__next") - F.col(t) >= limit)
    return d.where(silent & (F.col(gesture) != 0)).select(*keys, (F.col(t) + limit).alias("forced_t"), F.col(gesture).alias("was"))


def ordered_labels(events: DataFrame, keys, order, undo: Column, labels: int = 4, levels=()) -> DataFrame:
    """The n-th standing event takes label n mod `labels`; an undo removes the last one.

    The number standing is a sum that never falls under 0: the running sum minus its lowest value so far.
    """
    d = scan(events.withColumn("__d", F.when(undo, -1).otherwise(1)), keys, order, {"__s": running("sum", "__d")}, levels)
    d = scan(d, keys, order, {"__low": running("min", F.least("__s", F.lit(0)))}, levels)
    d = d.withColumn("standing", F.col("__s") - F.col("__low"))
    return d.withColumn("label", F.when(~undo, (F.col("standing") - 1) % labels)).drop("__d", "__s", "__low")


def trailing_envelope(df: DataFrame, keys, n: str, energy: str, rows: int, name="envelope", block_rows=16_384) -> DataFrame:
    """Root of the mean energy over the last `rows` rows."""
    from pyspark.sql import Window
    h = S.halo(df, n, block_rows, rows - 1, 0)
    w = Window.partitionBy(*keys, "hblk").orderBy(n).rowsBetween(-(rows - 1), 0)
    return h.withColumn(name, F.sqrt(F.greatest(F.avg(energy).over(w), F.lit(0.0)))).where("own").drop("hblk", "own")


def activity(df: DataFrame, keys, n: str, t: str, energy: str, chunk: str, baseline_rows: int, window: int, onset_rows: int,
             quiet_rows: int, refractory_rows: int, onset_sigma=8.0, offset_sigma=3.0, floor=1e-6) -> DataFrame:
    """Adaptive activity events: the first rows of a key fit the thresholds, later rows run the machine."""
    e = trailing_envelope(df, keys, n, energy, window)
    first = e.where(F.col(n) < baseline_rows)  # bounded rows per key
    base = first.groupBy(*keys).agg(F.percentile("envelope", 0.5).alias("b"), F.stddev_pop("envelope").alias("sd"), F.count(F.lit(1)).alias("c"))
    mad = first.join(small(base), keys).groupBy(*keys).agg(F.percentile(F.abs(F.col("envelope") - F.col("b")), 0.5).alias("mad"))
    base = base.join(mad, keys).where(F.col("c") >= baseline_rows)
    scale = F.greatest(1.4826 * F.col("mad"), 0.25 * F.col("sd"), F.lit(floor))
    limits = base.select(*keys, (F.col("b") + onset_sigma * scale).alias("on"), (F.col("b") + offset_sigma * scale).alias("off"))
    later = e.where(F.col(n) >= baseline_rows).join(small(limits), keys).select(*keys, chunk, F.col(n).alias("n"), F.col(t).alias("t"), "envelope", "on", "off")
    run = by_row(steps.activity(onset_rows, quiet_rows, refractory_rows), ("onset", "offset", "peak"))
    return chunked_fold(later, keys, ["n"], chunk, run, steps.ACTIVITY_START, "onset bigint, offset bigint, peak double")


def motion_track(df: DataFrame, keys, n: str, chunk: str, batch: int = 8) -> DataFrame:
    """Motion 0..1 per batch of IMU rows: gravity removed, scores blended, asymmetric smoothing. Reads x, y, z, gx, gy, gz."""
    axes = ("x", "y", "z")
    g = blended(df.select(*keys, chunk, F.col(n).alias("n"), *axes), keys, "n", chunk, axes, steps.GRAVITY_WEIGHT)
    lin = g.select(*keys, "n", F.sqrt(sum((F.col(c) - F.col(f"{c}_mean")) ** 2 for c in axes)).alias("linear"))
    rot = df.select(*keys, F.col(n).alias("n"), (F.col("gx") ** 2 + F.col("gy") ** 2 + F.col("gz") ** 2).alias("g2"))
    b = lin.join(rot, [*keys, "n"]).groupBy(*keys, F.floor(F.col("n") / batch).alias("b")).agg(
        F.sqrt(F.avg(F.col("linear") ** 2)).alias("l"), F.sqrt(F.avg("g2")).alias("r"))
    # fixed values: score offsets and spans
    x = clamp01(0.58 * clamp01((F.col("l") - 0.08) / 2.8) + 0.42 * clamp01((F.col("r") - 0.03) / 2.6))
    s = b.select(*keys, F.col("b").alias("n"), x.alias("x"), F.floor(F.col("b") / 65_536).alias("__c"))
    return chunked_fold(s, keys, ["n"], "__c", by_row(steps.asymmetric(0.38, 0.13), ("n", "motion")), 0.0, "n bigint, motion double")


def profiles(events: DataFrame, keys, chunk: str, weights=steps.PROFILE_WEIGHTS) -> DataFrame:
    """Blended control profile after every event. Reads n, kind, motion, muscle, held."""
    return chunked_fold(events.select(*keys, chunk, "n", "kind", "motion", "muscle", "held"), keys, ["n"], chunk,
                        by_row(steps.profile(weights), ("n", "motion", "muscle", "hold_ms")), steps.PROFILE_START,
                        "n bigint, motion double, muscle double, hold_ms bigint")


def development(events: DataFrame, keys, order, kind: str, levels=()) -> DataFrame:
    """Running number of enter events per key."""
    return scan(events, keys, order, {"generation": running("sum", (F.col(kind) == "enter").cast("bigint"))}, levels)
