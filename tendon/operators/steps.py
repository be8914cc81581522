"""State machines as pure steps: (state, row) -> (state, [output tuple, ...]).

Batch lifts a step with `folds.by_row`; the streaming operators run the same
step over each micro-batch. States are small JSON lists; none of them counts
rows, so a chunk forgets a wrong start and the batch fold settles quickly.
"""

from __future__ import annotations

# fixed values
RELEASES = ("index_release", "middle_release")
PRESS_TO_RELEASE = {"index_press": "index_release", "middle_press": "middle_release"}
IDLE, ONSET, ACTIVE, HOLD, RELEASE, TRANSITION, UNKNOWN = 0, 1, 2, 3, 4, 5, -1


def debounce(gap, releases=RELEASES, keep_after_release=False):
    """Keep a row unless it is within `gap` of the last kept one; a release other than that one stays.

    `keep_after_release` is the older rule: a row after a nearby release stays too.
    """
    def step(state, r):
        name, t = r["name"], r["t"]
        if state is not None and t - state[1] < gap:
            spared = name in releases and name != state[0]
            if keep_after_release and name not in releases and state[0] in releases:
                spared = True
            if not spared:
                return state, []
        return [name, t], [(t, name)]
    return step


def merge_prompts(minimum):
    """Tag rows with the position of the first row of their merged prompt."""
    def step(state, r):
        first, length = state
        first = r["n"] if length == 0 else first
        length += r["len"]
        return [first, 0 if length >= minimum else length], [(r["n"], first)]
    return step


def sequence_audit(state, r):
    """8-bit sequence: repeat, forward step with losses, or late; a late packet does not move the reference."""
    seq = int(r["seq"])
    if state is None:
        return seq, [(r["t"], 0, False, False)]
    d = (seq - state) % 256
    if d == 0:
        return state, [(r["t"], 0, True, False)]
    if d <= 128:
        return seq, [(r["t"], d - 1, False, False)]
    return state, [(r["t"], 0, False, True)]


def blend(weight):
    """(1-w) old + w new; the first value stands alone."""
    def step(y, r):
        y = r["x"] if y is None else (1.0 - weight) * y + weight * r["x"]
        return y, [(r["n"], y)]
    return step


def asymmetric(up, down):
    """Smoothing that follows rises with `up` and falls with `down`, within [0, 1]."""
    def step(y, r):
        a = up if r["x"] >= y else down
        y = min(1.0, max(0.0, y + a * (r["x"] - y)))
        return y, [(r["n"], y)]
    return step


def greedy_match(tolerance):
    """Each prediction in order takes the nearest unused truth within the tolerance.

    A prediction waits until the stream passes t + tolerance, so the state holds
    only what lies within two tolerances. Rows: t, side (0 truth, 1 prediction, 2 end of key).
    """
    def step(state, r):
        truths, waiting = [list(x) for x in state]
        out, now, end = [], r["t"], r["side"] == 2
        while waiting and (end or waiting[0] + tolerance < now):
            p = waiting.pop(0)
            near = min(((abs(p - t), i) for i, t in enumerate(truths) if abs(p - t) <= tolerance), default=None)
            out.append((p, truths.pop(near[1]) if near else None))
        if not end:
            (truths if r["side"] == 0 else waiting).append(now)
        low = (waiting[0] if waiting else now) - tolerance
        return [[t for t in truths if t >= low], [] if end else waiting], out
    return step


def phase_tracker(idle=0, confirm=2, hold_after=3):
    """Two-frame confirmation with onset, release and transition; unknown frames keep the stable label.

    State: [stable, candidate, candidate frames, stable frames (up to hold_after)].
    """
    def step(state, r):
        stable, cand, seen, steady = state
        label = int(r["label"])
        if label == -1:
            return [stable, -1, 0, 0], [(r["n"], -1, UNKNOWN)]
        if label == stable:
            steady = min(steady + 1, hold_after)
            phase = IDLE if label == idle else HOLD if steady >= hold_after else ACTIVE
            return [stable, label, 0, steady], [(r["n"], stable, phase)]
        seen = seen + 1 if label == cand else 1
        if seen >= confirm:
            return [label, label, 0, 0], [(r["n"], label, IDLE if label == idle else ACTIVE)]
        pending = ONSET if stable == idle else RELEASE if label == idle else TRANSITION
        return [stable, label, seen, steady], [(r["n"], stable, pending)]
    return step


def open_tracker(idle=0, open_label=3, release_after=8, confirm=2, hold_after=3):
    """Phase tracker that holds an open hand through idle frames until `release_after` of them."""
    base = phase_tracker(idle, confirm, hold_after)

    def step(state, r):
        inner, quiet = state
        label = int(r["label"])
        if inner[0] == open_label and label == idle:
            if quiet + 1 < release_after:
                steady = min(inner[3] + 1, hold_after)
                return [[*inner[:3], steady], quiet + 1], [(r["n"], open_label, HOLD)]
            return [[idle, idle, 0, 0], 0], [(r["n"], idle, RELEASE)]
        inner, out = base(inner, r)
        return [inner, quiet if label == idle else 0], out
    return step


def gesture_frames(stable_ms=120):
    """Stable gesture per frame; a candidate must last `stable_ms`. State: [stable, candidate, since]."""
    def step(state, r):
        stable, cand, since = state
        t, g = int(r["t"]), int(r["gesture"])
        if g == stable:
            return [stable, stable, None], [(t, r["id"], stable, None)]
        since = t if g != cand else since
        if t - since < stable_ms:
            return [stable, g, since], []
        return [g, g, None], [(t, r["id"], g, stable)]
    return step


def gesture_events(stable_ms=120):
    """Enter, hold and exit events for a live stream; adds the time of the last change to the state."""
    inner = gesture_frames(stable_ms)

    def step(state, r):
        body, since = state
        body, out = inner(body, r)
        made = []
        for t, _, stable, left in out:
            if left is None:
                made.append((t, "hold", stable, max(0, t - since)))
            else:
                made += [(t, "exit", left, max(0, t - since)), (t, "enter", stable, 0)]
                since = t
        return [body, since], made
    return step


GESTURE_START = [0, 0, None]


def press_release(minimum):
    """Pair presses with releases. State: pending press [name, t].

    An orphan release is dropped; any other event first closes an open press
    with a synthetic release.
    """
    def step(pending, r):
        name, t, out = r["name"], r["t"], []
        if pending is not None:
            want, held = PRESS_TO_RELEASE[pending[0]], max(0, t - pending[1])
            if name == want:
                return None, [(t, name, False, held, held >= minimum)]
            out.append((t, want, True, held, False))
        if name in PRESS_TO_RELEASE:
            return [name, t], [*out, (t, name, False, None, None)]
        if name not in RELEASES:
            out.append((t, name, False, None, None))
        return None, out
    return step


def activity(onset_rows, quiet_rows, refractory_rows):
    """Onset, activity and quiet phases of an envelope against two thresholds on the row.

    State: [mode, count, candidate time, start, peak, quiet start].
    """
    def step(state, r):
        mode, count, mark, start, peak, quiet = state
        e, t = r["envelope"], r["t"]
        if mode == "refractory":
            return (["waiting", 0, None, None, None, None] if count <= 1 else ["refractory", count - 1, None, None, None, None]), []
        if mode == "waiting":
            if e < r["on"]:
                return ["waiting", 0, None, None, None, None], []
            mark = t if count == 0 else mark
            if count + 1 >= onset_rows:
                return ["active", 0, None, mark, e, None], []
            return ["waiting", count + 1, mark, None, None, None], []
        peak = max(peak, e)
        if e > r["off"]:
            return ["active", 0, None, start, peak, None], []
        quiet = t if count == 0 else quiet
        if count + 1 >= quiet_rows:
            return ["refractory", refractory_rows, None, None, None, None], [(start, quiet, peak)]
        return ["active", count + 1, None, start, peak, quiet], []
    return step


ACTIVITY_START = ["waiting", 0, None, None, None, None]


def drop_late(strict=True):
    """Rows at or before (strict) or before (not strict) the last accepted time are dropped."""
    def step(last, r):
        t = r["t"]
        if last is not None and (t <= last if strict else t < last):
            return last, []
        return t, [(t, r["id"])]
    return step


# fixed values: weight of a new value by event kind
PROFILE_WEIGHTS = {"enter": 0.34, "effort": 0.10, "hold": 0.06, "exit": 0.30}
GLOBAL_WEIGHTS = {"enter": 0.16, "effort": 0.08, "hold": 0.025}


def profile(weights=PROFILE_WEIGHTS):
    """Blended motion, muscle and hold time. State: [motion, muscle, hold, any row seen]."""
    def step(state, r):
        motion, muscle, hold, seen = state
        kind = r["kind"]
        if kind not in weights:
            return state, []
        w = weights[kind] if seen else 1.0
        m = r["motion"] if kind in ("enter", "hold") else motion
        e = muscle if kind == "exit" else r["muscle"]
        h = r["held"] if kind in ("exit", "hold") else hold
        mix = lambda a, b: (1.0 - w) * a + w * b
        new = [mix(motion, m), mix(muscle, e), round(mix(hold, h)), True]
        return new, [(r["n"], *new[:3])]
    return step


PROFILE_START = [0.5, 0.5, 450, False]


GRAVITY_WEIGHT = 0.035  # fixed value: weight of a new row in the running gravity estimate
