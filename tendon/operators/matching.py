"""Event sequence alignment and the error rates built on it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut
from .folds import grouped_rows
from .ordered import index, running, scan
from .sequences import overlap_groups

# fixed values: seconds before and after a label; state after a label; releases barred in a state
TOLERANCE = (-0.05, 0.25)
STATE_AFTER = {"index_press": "INDEX", "middle_press": "MIDDLE"}
BARRED = {"NEUTRAL": ("index_release", "middle_release"), "INDEX": ("middle_release",), "MIDDLE": ("index_release",)}


def _pairs(left, right):
    """Matched index pairs of two event lists (name, time, start, end) of one stretch.

    Cheapest by (unmatched and misnamed events, total time distance); only
    overlapping intervals may pair. A row of the table needs the row above.
    """
    rows, cols = len(left) + 1, len(right) + 1
    cost = [(j, 0.0) for j in range(cols)]
    moves = np.zeros((rows, cols), dtype=np.int8)
    moves[0, 1:] = 2
    for i in range(1, rows):
        name, time, start, end = left[i - 1]
        line = [(i, 0.0)]
        moves[i, 0] = 1
        for j in range(1, cols):
            other, when, lo, hi = right[j - 1]
            options = [((cost[j][0] + 1, cost[j][1]), 1), ((line[j - 1][0] + 1, line[j - 1][1]), 2)]
            if end >= lo and hi >= start:
                options.append(((cost[j - 1][0] + (name != other), cost[j - 1][1] + abs(time - when)), 3))
            best = min(options, key=lambda o: o[0])
            line.append(best[0])
            moves[i, j] = best[1]
        cost = line
    i, j, out = rows - 1, cols - 1, []
    while i and j:
        if moves[i, j] == 3:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif moves[i, j] == 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def stretch_pairs(pred: DataFrame, truth: DataFrame, key: str, slot_seconds=3600.0, tolerance=TOLERANCE, pred_left=True) -> DataFrame:
    """(key, p, g) matched positions. Both sides are (key, i, name, t).

    Padded labels and predictions are grouped into stretches whose intervals
    touch. Nothing can pair across a stretch border and costs add up, so the
    stretches are aligned apart, in parallel.
    """
    p = pred.select(key, "i", "name", "t", F.col("t").alias("a"), F.col("t").alias("b"), F.lit(1).alias("side"))
    g = truth.select(key, "i", "name", "t", (F.col("t") + tolerance[0]).alias("a"), (F.col("t") + tolerance[1]).alias("b"), F.lit(0).alias("side"))
    both = p.unionByName(g).withColumn("slot", F.floor(F.col("a") / slot_seconds))
    both = overlap_groups(both, [key], ["a", "side", "i"], "a", "b", [["slot"]])

    def one(rows):
        side = {s: [r for r in rows if r["side"] == s] for s in (0, 1)}
        if not side[0] or not side[1]:
            return []
        ev = {s: [(r["name"], r["t"], r["a"], r["b"]) for r in d] for s, d in side.items()}
        hits = _pairs(ev[1], ev[0]) if pred_left else [(b, a) for a, b in _pairs(ev[0], ev[1])]
        return [(rows[0][key], side[1][p]["i"], side[0][g]["i"]) for p, g in hits]

    return grouped_rows(both.select(key, "grp", "side", "i", "name", "t", "a", "b"), [key, "grp"], ["i"], one, [key, "p", "g"],
                        f"{key} {pred.schema[key].dataType.simpleString()}, p bigint, g bigint")


def confusion(pred: DataFrame, truth: DataFrame, key: str, slot_seconds=3600.0, tolerance=TOLERANCE) -> DataFrame:
    """(truth name, predicted name or NULL, n) after alignment, state filter and a second alignment.

    In the full alignment the labels between two matched pairs come before the
    predictions between them. So the state met by a prediction is the one after
    the label just before the next matched label; a scan finds it.
    """
    lev = [["slot"]]
    # every stage feeds several later ones, so each is written once instead of computed again per use
    num = lambda d: cut(scan(d.select(key, "name", F.col("t").cast("double").alias("t")).withColumn("slot", F.floor(F.col("t") / slot_seconds)),
                             [key], ["t", "name"], {"i": index()}, lev))
    p, g = num(pred), num(truth)
    hits = cut(stretch_pairs(p, g, key, slot_seconds, tolerance))
    q = p.join(hits.withColumnRenamed("p", "i"), [key, "i"], "left")
    total = g.groupBy(key).agg(F.count(F.lit(1)).alias("labels"))
    q = scan(q, [key], ["i"], {"next_g": running("first_from", "g")}, lev).join(total, key, "left")
    q = q.withColumn("at", F.coalesce("next_g", "labels", F.lit(0)) - 1)
    before = g.select(key, F.col("i").alias("at"), F.col("name").alias("before"))
    q = q.join(before, [key, "at"], "left")
    state = F.coalesce(*[F.when(F.col("before") == n, s) for n, s in STATE_AFTER.items()], F.lit("NEUTRAL"))
    barred = F.lit(False)
    for s, names in BARRED.items():
        barred = barred | ((state == s) & F.col("name").isin(*names))
    kept = num(q.where(~barred).select(key, "name", "t"))
    second = stretch_pairs(kept, g, key, slot_seconds, tolerance, pred_left=False)
    d = g.select(key, F.col("i").alias("g"), F.col("name").alias("truth")).join(second, [key, "g"], "left")
    d = d.join(kept.select(key, F.col("i").alias("p"), F.col("name").alias("pred")), [key, "p"], "left")
    return d.groupBy(key, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def cler(conf: DataFrame) -> DataFrame:
    """Mean over truth names of 1 - correct/matched; misses and names outside the truth set stay out."""
    names = conf.select(F.col("truth").alias("pred")).distinct()  # one row per gesture
    inside = conf.join(F.broadcast(names), "pred")
    per = inside.groupBy("truth").agg((1 - F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("e"))
    return per.agg(F.coalesce(F.avg("e"), F.lit(0.0)).alias("cler"))


def mean_fnr(conf: DataFrame) -> DataFrame:
    """Mean over truth names of 1 - correct/total; misses count."""
    per = conf.groupBy("truth").agg((1 - F.sum(F.when(F.coalesce(F.col("truth") == F.col("pred"), F.lit(False)), F.col("n")).otherwise(0)) / F.sum("n")).alias("e"))
    return per.agg(F.coalesce(F.avg("e"), F.lit(0.0)).alias("mean_fnr"))


#: Cells of one diagonal of the edit tables that are worked together.
CELLS = 32_768


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


def _trimmed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without what they begin and end with in common; that changes no cheapest edit's cost."""
    n = min(len(x), len(y))
    other = np.flatnonzero(x[:n] != y[:n])
    at = int(other[0]) if len(other) else n
    x, y, n = x[at:], y[at:], n - at
    other = np.flatnonzero(x[len(x) - n:][::-1] != y[len(y) - n:][::-1])
    end = int(other[0]) if len(other) else n
    return x[:len(x) - end], y[:len(y) - end]


def _edit_costs(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """(edits, gaps) of a shortest edit with the fewest gaps for each pair, all tables at once, diagonal by diagonal."""
    xs, ys = np.array([len(x) for x, _ in pairs]), np.array([len(y) for _, y in pairs])
    n, m = int(xs.max()), int(ys.max())
    big = n + m + 1
    kind = np.int32 if (big + 1) * big < 1 << 31 else np.int64
    a, b = np.full((n, len(pairs)), -1, np.int32), np.full((m, len(pairs)), -2, np.int32)
    for p, (x, y) in enumerate(pairs):
        a[:len(x), p], b[:len(y), p] = x, y
    b = b[::-1]  # along a diagonal one text runs up, the other down
    last, now, new = (np.zeros((n + 1, len(pairs)), kind) for _ in range(3))  # row i holds (i, k - i)
    ready = {k: np.flatnonzero(xs + ys == k) for k in set((xs + ys).tolist())}
    cost = np.zeros(len(pairs), np.int64)
    for k in range(1, n + m + 1):
        lo, hi = max(1, k - m), min(n, k - 1)
        if k <= m:
            new[0] = k * (big + 1)
        if k <= n:
            new[k] = k * (big + 1)
        if lo <= hi:
            out = new[lo:hi + 1]
            np.minimum(now[lo:hi + 1], now[lo - 1:hi], out=out)
            out += big + 1  # one edit, one gap
            change = (a[lo - 1:hi] != b[m - k + lo:m - k + hi + 1]).astype(kind)
            change *= big
            change += last[lo - 1:hi]
            np.minimum(out, change, out=out)
        if k in ready:
            cost[ready[k]] = new[xs[ready[k]], ready[k]]
        last, now, new = now, new, last
    return [divmod(int(c), big) for c in cost]


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("insertions", "deletions", "replacements")]))
def edit_split(pred: pd.Series, target: pd.Series) -> pd.DataFrame:
    """Insertions, deletions and replacements of a shortest edit with the fewest gaps. Null where a text is null."""
    out: list[tuple] = [(None, None, None)] * len(pred)
    left = {i: _trimmed(_codes(a), _codes(b)) for i, (a, b) in enumerate(zip(pred, target)) if a is not None and b is not None}
    order = sorted(left, key=lambda i: (len(left[i][0]), len(left[i][1])), reverse=True)  # alike in length, the longest first
    while order:
        many = max(1, CELLS // (len(left[order[0]][0]) + 1))
        own, order = order[:many], order[many:]
        for i, (edits, gaps) in zip(own, _edit_costs([left[i] for i in own])):
            ins = (gaps + len(left[i][1]) - len(left[i][0])) // 2
            out[i] = (ins, gaps - ins, edits - gaps)
    return pd.DataFrame(out, columns=["insertions", "deletions", "replacements"])


def proxy_accuracy(frames: DataFrame, onsets: DataFrame, keys, n: str, before: int, after: int, onset_id: str, cls="o", p="p") -> DataFrame:
    """Class of the largest probability in [onset-before, onset+after); mean accuracy over truth classes."""
    from .joins import interval_join
    spans = onsets.select(*keys, onset_id, "truth", (F.col("at") - before).alias("__a"), (F.col("at") + after).alias("__b"))
    hit = interval_join(frames.select(*keys, n, cls, p), spans, keys, n, "__a", "__b", width=64)
    best = hit.groupBy(*keys, onset_id).agg(F.first("truth").alias("truth"), F.min_by(cls, F.struct((-F.col(p)).alias("p"), n, cls)).alias("guess"))
    per = best.groupBy("truth").agg(F.avg((F.col("truth") == F.col("guess")).cast("double")).alias("acc"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.avg("acc").alias("accuracy"), F.sum("n").alias("onsets"))


def sweep(frames: DataFrame, truth: DataFrame, key: str, cls: str, n: str, p: str, grid, tolerance, chunk_rows=65_536) -> DataFrame:
    """tp, fp, fn per (class, threshold). Only thresholds crossed by a step make a row.

    truth: (key, cls, t). The frames are scanned once for all thresholds.
    """
    from .events import match_counts, match_events
    # frames and truths in one order: the frame before, and the nearest truths on both sides
    side = truth.select(key, cls, F.col("t").alias(n), F.lit(None).cast(frames.schema[p].dataType).alias(p), F.lit(0).alias("__side"))
    d = frames.select(key, cls, n, p, F.lit(1).alias("__side")).unionByName(side).withColumn("__slot", F.floor(F.col(n) / chunk_rows))
    at = F.when(F.col("__side") == 0, F.col(n))
    d = scan(d, [key, cls], [n, "__side"], {"__was": running("last_before", F.when(F.col("__side") == 1, F.struct(F.col(p).alias("v")))),
                                            "__left": running("last", at), "__right": running("first_from", at)}, [["__slot"]]).where("__side = 1")
    ts = F.array(*[F.lit(float(t)) for t in grid])
    was = F.col("__was.v")
    up = F.filter(ts, lambda t: (t <= F.col(p)) & (was.isNull() | (t > was)))
    near = F.coalesce((F.col(n) - F.col("__left") <= tolerance) | (F.col("__right") - F.col(n) <= tolerance), F.lit(False))
    pred = cut(d.select(key, cls, F.col(n).alias("t"), near.alias("near"), up.alias("up")).where(F.size("up") > 0))
    steps_up = pred.select(key, cls, "t", "near", F.explode("up").alias("threshold"))
    # a step without a truth in reach is a false positive whatever else happens; only the others are matched
    keys = [key, cls, "threshold"]
    asked = steps_up.where("near").drop("near")
    goal = truth.select(key, cls, "t", F.explode(ts).alias("threshold")).join(asked.select(*keys).distinct(), keys, "left_semi")
    m = match_events(asked, goal, keys, "t", tolerance, F.floor(F.col("t") / chunk_rows))
    per = match_counts(m, asked, goal, keys).groupBy(cls, "threshold").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    alone = steps_up.where("NOT near").groupBy(cls, "threshold").agg(F.lit(0).cast("long").alias("tp"), F.count(F.lit(1)).alias("fp"))
    truths = truth.groupBy(cls).agg(F.count(F.lit(1)).alias("truths")).select(cls, F.explode(ts).alias("threshold"), "truths")
    found = per.unionByName(alone).groupBy(cls, "threshold").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    both = truths.join(found, [cls, "threshold"], "full_outer").fillna(0, ["tp", "fp", "truths"])
    return both.select(cls, "threshold", "tp", "fp", (F.col("truths") - F.col("tp")).alias("fn"))


def best_thresholds(counts: DataFrame, cls: str) -> DataFrame:
    """Per class the lowest threshold with the best F1."""
    f1 = 2 * F.col("tp") / F.greatest(F.lit(1e-12), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.withColumn("f1", F.round(f1, 12)).groupBy(cls).agg(
        F.min_by(F.struct("threshold", "f1"), F.struct((-F.col("f1")).alias("f"), "threshold")).alias("b")).select(cls, "b.threshold", "b.f1")


def best_global(counts: DataFrame, cls: str, minutes: float, top=0.50) -> DataFrame:
    """One threshold for all classes: best (-macro F1, mean FNR, false positives per minute, -threshold)."""
    f1 = 2 * F.col("tp") / F.greatest(F.lit(1e-12), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    fnr = F.when(F.col("tp") + F.col("fn") > 0, F.col("fn") / (F.col("tp") + F.col("fn")))
    per = counts.where(F.col("threshold") <= top + 1e-9).groupBy("threshold").agg(F.avg(f1).alias("macro_f1"), F.coalesce(F.avg(fnr), F.lit(0.0)).alias("mean_fnr"),
                                                                                 (F.sum("fp") / minutes).alias("fp_per_minute"))
    key = F.struct((-F.round("macro_f1", 12)).alias("a"), F.round("mean_fnr", 12).alias("b"), "fp_per_minute", (-F.col("threshold")).alias("d"))
    return per.agg(F.min_by(F.struct("*"), key).alias("r")).select("r.*")
