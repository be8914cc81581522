"""Structure repair and the prefix trie against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from tendon.llm import prefix_trie, repair, ropes
from tendon.llm.ternary import TernaryTree

SCHEMA = "conv_id long, turn long, role string, text string, cost string, conv string, depth string, `row` string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


# 11 structure repair

def told(rows):
    """Faults by the rule, for rows in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("x" if not bare or (role, text) in seen else "T" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows):
    """(cost, audit) over every edit sequence of a few rows."""
    best = None
    faults = told(rows)
    gaps = ["", "u", "a", "ua", "au"]
    choices = [("D",) if f == "x" else ("K", "u", "a", "D") for f in faults]
    for edits in product(*choices):
        for between in product(gaps, repeat=len(rows) + 1):
            out, audit, cost = "", "", 0
            for i, gap in enumerate(between):
                out, audit, cost = out + gap, audit + "I" * len(gap), cost + 5 * len(gap)
                if i < len(rows):
                    e = edits[i]
                    cost += {"K": 0, "D": 2}.get(e, 1) + (5 if e != "D" and faults[i] == "T" else 0)
                    audit += e if e in "KD" else "R"
                    out += "" if e == "D" else rows[i][0][:1] or "?" if e == "K" else e
            rest = out[1:] if out[:1] == "s" else out
            if len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2) and not (out == "s") and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def result(spark, rows, **how):
    done = repair.repair(rows, **how)
    summary = {r.conv: r for r in done.summary.collect()}
    turns = {}
    for r in done.turns.orderBy("row", "place").collect():
        turns.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    digest = {r.conv: r.repaired_sha256 for r in repair.digests(done.turns).collect()}
    assert digest == {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in turns.items()}
    return summary, turns


def test_cheapest_edits(spark):
    rng = random.Random(3)
    made = {}
    for c in range(120):
        made[c] = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["One.", "two", " ", "Three!", "four? \n"])) for _ in range(rng.randint(1, 3))]
    rows = [(c, t, role, text) for c, turns in made.items() for t, (role, text) in enumerate(turns)]
    summary, turns = result(spark, rows_of(spark, rows).repartition(5))
    for c, given in made.items():
        assert (summary[c].cost, summary[c].audit) == exhaustive(given), given
        initials = "".join(t.split(":")[0][:1] for t in turns.get(c, []))
        rest = initials.removeprefix("s")
        assert rest == "ua" * (len(rest) // 2)
        assert summary[c].blank + summary[c].duplicate == told(given).count("x") and summary[c].truncated == told(given).count("T")


def plain(signs):
    """(cost, audit) by one vector of strings."""
    vector = {0: (0, "")}
    for s in signs:
        new = {}
        for i, (c, a) in vector.items():
            for j, (d, b) in ropes.symbol(s)[i].items():
                end = (c + d, a + str(b).translate(ropes.AUDIT))
                new[j] = min(new.get(j, end), end)
        vector = new
    return min((c + ropes.LAST[j][0], a + ropes.LAST[j][1].translate(ropes.AUDIT)) for j, (c, a) in vector.items())


@pytest.mark.parametrize("block", [3, 65_536])
def test_long_conversations_in_blocks(spark, block):
    rng = random.Random(5)
    rows = []
    for c in range(6):
        for t in range(150 if c < 2 else 9):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice([f"Text {t}.", f"open {t}", "", "Same."])))
    summary, _ = result(spark, rows_of(spark, rows).repartition(7), block=block)
    for c in range(6):
        own = [(r, x) for k, _, r, x in rows if k == c]
        signs = [f if f == "x" else (r[0] if r[0] in "sua" else "o").upper() if f == "T" else r[0] if r[0] in "sua" else "o" for (r, _), f in zip(own, told(own), strict=True)]
        assert (summary[c].cost, summary[c].audit) == plain(signs)
        assert summary[c].illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))


def test_rules_share_and_change_nothing():
    words = ["".join(random.Random(i).choices("suaxUA", k=40)) for i in range(30)]
    rules = ["ua", ropes.rule_sign(0) * 2, "xu", "au"]
    known = ropes.matrices(rules)
    for w in words + ["ua" * 500, ""]:
        vector = {0: (0, ropes.Rope(""))}
        for sign in ropes.compressed(w, rules):
            vector = ropes.through(vector, known[sign])
        assert min((c + ropes.LAST[j][0], str(r).translate(ropes.AUDIT) + ropes.LAST[j][1].translate(ropes.AUDIT)) for j, (c, r) in vector.items()) == plain(w)
    a, b = ropes.Rope("K") + (ropes.Rope("KD") + ropes.Rope("D")), (ropes.Rope("KK") + ropes.Rope("D")) + ropes.Rope("KI")
    assert ropes.less(a, b) == (str(a) < str(b)) and ropes.less(b, a) == (str(b) < str(a)) and not ropes.less(a, a)
    assert ropes.less(ropes.Rope("K"), ropes.Rope("K") + ropes.Rope("D"))


def test_repair_odd(spark):
    long = "word " * 400_000 + "end."
    rows = [(1, None, None, "No role."), (1, 5, "user", None), (1, 5, "user", long), (1, 9, "assistant", "Fine."), (1, 9, "assistant", "Fine."),
            (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (2, None, "user", "A."), (2, None, "assistant", "B."), (3, 1, "user", ""), (4, 1, "", "x."), (4, 2, "supervisor", "Yes.")]
    summary, turns = result(spark, rows_of(spark, rows).repartition(3))
    assert set(summary) == {1, 2, 3, 4, None}
    assert (summary[1].gaps, summary[1].blank, summary[1].duplicate, summary[1].truncated) == (3, 1, 1, 0)
    assert (summary[None].cost, summary[None].audit, turns[None]) == (0, "KK", ["user:Hi.", "assistant:Ho."])
    assert (summary[2].gaps, summary[2].illegal) == (0, 0) and summary[2].audit == "RR" and turns[2] == ["user:B.", "assistant:A."]  # ties by role: the assistant's row is first
    assert (summary[3].cost, summary[3].audit) == (2, "D") and 3 not in turns
    assert summary[4].audit == "RR" and turns[4] == ["user:x.", "assistant:Yes."]
    empty, none = result(spark, rows_of(spark, rows).limit(0))
    assert not empty and not none


# 12 prefix trie

def brute(convs, words):
    """(smallest, depth) to the numbers of every prefix."""
    nodes = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = {}
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        leaves = sum(not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in nodes) for q in below)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        out[min(members), len(p)] = (min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 and q[:len(p)] == p for q in nodes), leaves,
                                     sum((len(nodes[q]) - 1) * words(q[-1]) for q in below if q), hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie_of(rows, **how):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.prefix_trie(rows, **how).collect()}


@pytest.mark.parametrize("shard_turns", [8, 200_000])
def test_trie_against_brute_force(spark, shard_turns):
    rng = random.Random(9)
    convs = {}
    for c in range(150):
        base = list(convs[rng.choice(list(convs))]) if convs and rng.random() < 0.8 else []
        seq = base[:rng.randint(0, len(base))] + [(rng.choice(["user", "assistant"]), " ".join(["w"] * rng.randint(0, 4))) for _ in range(rng.randint(0, 4))]
        convs[rng.randint(-500, 10_000)] = seq
    for c in range(20_000, 20_060):
        convs[c] = [("user", "the same"), ("assistant", "first turns"), ("user", f"w {c % 7}")]
    rows = [(c, t, r, x) for c, seq in convs.items() for t, (r, x) in enumerate(seq)]
    ids = spark.createDataFrame([(c,) for c in convs], "conv long")
    assert trie_of(rows_of(spark, rows).repartition(5), convs=ids, shard_turns=shard_turns) == brute(convs, lambda t: len(t[1].split()))


def test_trie_odd(spark):
    long = "word " * 300_000
    rows = [(1, None, None, None), (1, 2, "user", long), (2, 0, "", ""), (2, 1, "user", long), (None, 0, "user", "nobody's"), (3, 1, "user", "a b"), (3, 1, "user", "a b")]
    got = trie_of(rows_of(spark, rows))
    convs = {1: [("", ""), ("user", long)], 2: [("", ""), ("user", long)], 3: [("user", "a b"), ("user", "a b")]}
    assert got == brute(convs, lambda t: len(t[1].split()))
    assert trie_of(rows_of(spark, rows).limit(0)) == {}
    ids = spark.createDataFrame([(7,), (5,)], "conv long")
    assert trie_of(rows_of(spark, rows).limit(0), convs=ids) == {(5, 0): (None, 2, 0, 1, 0, hashlib.sha256(b"5,7").hexdigest())}


def test_trees_of_children_are_balanced():
    tree = TernaryTree.of([([i], [1], 1, i, "") for i in range(1023)])
    depth, todo = 0, [(tree.down[0], 1)]
    while todo:
        at, d = todo.pop()
        if at:
            depth = max(depth, d)
            todo += [(tree.low[at], d + 1), (tree.high[at], d + 1)]
    assert depth == 10
    deep = TernaryTree.of([(list(range(20_000)), [1] * 20_000, 1, 4, "")])
    assert len(deep.sums({0: ""})) == 20_001


def test_rebuilt_conversations(spark):
    from tendon.llm.queries import rebuilt
    rows = rows_of(spark, [(20, 0, "user", "b0"), (20, 1, "assistant", "b1"), (23, 0, "user", "o0"), (23, 1, "user", "o1"), (23, 2, "user", "o2"), (23, 3, "user", "o3"), (47, None, "user", "z")])
    import zlib
    got = {}
    for r in rebuilt(rows.select("conv_id", "turn", "role", "text")).orderBy("conv", "turn_no").collect():
        got.setdefault(r.conv, []).append(r.text)
    own = {20: ["b0", "b1"], 23: ["o0", "o1", "o2", "o3"], 47: ["z"]}
    want = {c: own.get(c - c % 20, [])[:zlib.crc32(str(c).encode()) % 4] + t[zlib.crc32(str(c).encode()) % 4:] for c, t in own.items()}
    assert got == {c: t for c, t in want.items() if t}
