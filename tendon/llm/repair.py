"""Repair of conversation structure: cheapest edits by min-plus matrices over a grammar that all conversations share."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.ordered import running, scan
from .common import saved, with_groups
from .ropes import AUDIT, LAST, STATES, Rope, compressed, matrices, through
from .turns import BLANKS, in_order, key_of

#: Rows of a conversation whose edits are one string; longer conversations are cut into such blocks.
BLOCK = 65_536
#: Rounds in which pairs are counted, and pairs that become rules in each. They bound the grammar, not what is repaired.
ROUNDS, PICKS = 6, 32
CELLS = "array<struct<i:int,j:int,cost:bigint,edits:string>>"


@dataclass(frozen=True)
class Repaired:
    """summary: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. turns: conv, row, place, role, text; (row, place) gives the order."""

    summary: DataFrame
    turns: DataFrame


def _pairs(rules: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[str] = Counter()
        for b in batches:
            for s in b.column(0):
                word, last = compressed(s.as_py()[1:], rules), -2
                for i in range(len(word) - 1):
                    pair = word[i:i + 2]
                    if pair[0] == pair[1] and last == i - 1:
                        last = -2  # the middle of a run of three is counted once
                        continue
                    tally[pair] += 1
                    last = i if pair[0] == pair[1] else -2
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["pair", "n"])

    return run


def grammar(sequences: DataFrame) -> list[str]:
    """Re-Pair over all distinct sequences: the most frequent pairs that share no sign become rules, round by round.

    Counts are made in the tasks and summed by pair; a round brings at most 4 PICKS pairs to the driver.
    """
    rules: list[str] = []
    for _ in range(ROUNDS):
        counts = sequences.select("seq").mapInArrow(_pairs(list(rules)), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        used: set[str] = set()
        fresh = []
        for r in counts.where("n > 1").orderBy(F.desc("n"), "pair").limit(4 * PICKS).collect():
            if not used & set(r.pair) and len(fresh) < PICKS:
                used |= set(r.pair)
                fresh.append(r.pair)
        if not fresh:
            break
        rules += fresh
    return rules


def _evaluate(rules: list[str]):
    """(seq, uses) to (seq, uses, cells): the cheapest edits from state to state; a sequence marked ^ opens its conversation, so it starts in the empty state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = matrices(rules)
        shape = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                cells = []
                for s in b.column(0)[at:at + 256]:
                    word = s.as_py()
                    made = []
                    for start in STATES[:1] if word[0] == "^" else STATES:
                        vector = {start: (0, Rope(""))}
                        for sign in compressed(word[1:], rules):
                            vector = through(vector, known[sign])
                        made += [{"i": start, "j": j, "cost": c, "edits": str(r)} for j, (c, r) in vector.items()]
                    cells.append(made)
                yield pa.RecordBatch.from_arrays([b.column(0)[at:at + 256], b.column(1)[at:at + 256], pa.array(cells, shape)], names=["seq", "uses", "cells"])

    return run


class _Path:
    """The edits chosen for the blocks so far, as a chain from the last block back."""

    __slots__ = ("before", "block", "edits")

    def __init__(self, before: _Path | None, block: int, edits: str):
        self.before, self.block, self.edits = before, block, edits


def _earlier(a: _Path, b: _Path) -> bool:
    """Whether the audit of `a` comes before that of `b`: both have the same blocks; what they share at the front is not looked at."""
    x, y = [], []
    while a is not b:
        x.append(a.edits)
        y.append(b.edits)
        a, b = a.before, b.before
    return "".join(reversed(x)).translate(AUDIT) < "".join(reversed(y)).translate(AUDIT)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over blocks sorted by (ckey, block): the edits of every block on the cheapest path, and on the first one the cost of the whole conversation."""
    key, vector = None, {}

    def closed():
        best = None
        for j, (cost, path) in vector.items():
            more, tail = LAST[j]
            end = (cost + more, _Path(path.before, path.block, path.edits + tail))
            if best is None or end[0] < best[0] or end[0] == best[0] and _earlier(end[1], best[1]):
                best = end
        out, path = [], best[1]
        while path is not None:
            out.append((key, path.block, path.edits, None if path.before else best[0]))
            path = path.before
        return out

    def rows(found):
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["ckey", "block", "edits", "cost"])

    for b in batches:
        done = []
        for k, block, cells in zip(*b.columns, strict=True):
            k, block, cells = k.as_py(), block.as_py(), cells.as_py()
            if k != key:
                if key is not None:
                    done += closed()
                key, vector = k, {c["j"]: (c["cost"], _Path(None, block, c["edits"])) for c in cells}
                continue
            new: dict[int, tuple[int, _Path]] = {}
            for c in cells:
                if c["i"] in vector:
                    cost, path = vector[c["i"]]
                    end, old = (cost + c["cost"], _Path(path, block, c["edits"])), new.get(c["j"])
                    if old is None or end[0] < old[0] or end[0] == old[0] and _earlier(end[1], old[1]):
                        new[c["j"]] = end
            vector = new
        yield rows(done)
    if key is not None:
        yield rows(closed())


def _faults(rows: DataFrame) -> DataFrame:
    """`rows` of `in_order` without texts, with the first fault of each and its sign for the grammar."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    told = rows.select("conv", "turn", "row", "part", F.substring("role", 1, 1).alias("initial"), key_of("conv").alias("ckey"), F.md5(key_of("conv", "role", "text")).alias("same"),
                       (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    again = told.groupBy("same").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    told = with_groups(told, again, ["same"], ["first"], "n", rows.count(), "row")
    fault = F.when(F.col("blank"), "blank").when(F.col("row") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    sign = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return told.withColumn("fault", fault).withColumn("sign", sign).select("conv", "turn", "row", "part", "initial", "ckey", "fault", "sign")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> Repaired:
    """Faults of every conversation, its cheapest edits into `(s?(ua)+)?` by role initials, and the turns after them.

    A row's first fault counts: blank (no sign but ASCII white space), duplicate (the conversation has role and text before), truncated (the last such sign is none of
    `.!?`). Keep costs 0, Rerole to user or assistant 1, Delete 2 (blank and duplicate rows must go), Insert of an empty user or assistant turn 5; a truncated row
    that stays costs 5 more. audit has the initials of the cheapest edits in order, of equal costs the least in ASCII.
    gaps is the last turn - the first + 1 - distinct turns, without nulls; illegal counts neighbours whose initials are not su, ua or au.

    Rows become signs of initial and fault. Re-Pair rules are made of all distinct sequences of signs; each sign and rule is a matrix of cheapest costs from state
    to state with ropes of edits, made bottom-up once, and equal sequences are evaluated once for all conversations. Sequences are blocks of at most `block` rows, cut
    where ranges of the order end, so a long conversation is many blocks whose matrices are joined in a stream. Edits go back to the rows by row number.

    Rows go by turn (null first), ties by role and text. Null roles and texts are one space. A null conversation id is a conversation of its own. Repeated rows are
    duplicates. Very long texts are only hashed and looked at from their end. An empty table gives empty results. Other columns are not looked at.
    """
    ordered = in_order(rows, conv, turn, role, text)
    faults = saved(_faults(ordered), "faults")
    before = scan(faults, ["ckey"], ["row"], {"prev": running("lag", "initial")}, [["part"]])
    bad = F.col("prev").isNotNull() & ~F.concat("prev", "initial").isin("su", "ua", "au")
    counts = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    told = before.groupBy("ckey").agg(F.first("conv").alias("conv"), *counts, F.count(F.when(bad, 1)).alias("illegal"))
    span = faults.groupBy("ckey", "turn").agg(F.lit(1)).groupBy("ckey").agg(F.coalesce((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long"), F.lit(0)).alias("gaps"))

    start = F.min("row").over(Window.partitionBy("ckey", "part"))  # dense inside a part
    cut = faults.select("ckey", "row", "sign", start.alias("start")).withColumn("block", F.col("row") - F.pmod(F.col("row") - F.col("start"), F.lit(block)))
    signs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "sign"))), lambda x: x["sign"]), "")  # at most `block` rows
    blocks = cut.groupBy("ckey", "block").agg(signs.alias("signs"))
    heads = blocks.groupBy("ckey").agg(F.min("block").alias("head"))
    blocks = saved(blocks.join(heads, "ckey").select("ckey", "block", F.concat(F.when(F.col("block") == F.col("head"), "^").otherwise("~"), "signs").alias("seq")), "blocks")
    sequences = saved(blocks.groupBy("seq").agg(F.count(F.lit(1)).alias("uses")), "sequences")
    solved = saved(sequences.mapInArrow(_evaluate(grammar(sequences)), f"seq string, uses long, cells {CELLS}"), "solved")
    met = with_groups(blocks, solved, ["seq"], ["cells"], "uses", blocks.count(), "block").select("ckey", "block", "cells")
    paths = saved(met.repartition("ckey").sortWithinPartitions("ckey", "block").mapInArrow(_chain, "ckey string, block long, edits string, cost long"), "paths")

    audit = F.translate(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "edits"))), lambda x: x["edits"]), ""), "UAua", "IIRR")
    costs = paths.groupBy("ckey").agg(F.sum("cost").alias("cost"), audit.alias("audit"))  # one string by definition
    summary = told.join(span, "ckey").join(costs, "ckey").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    pieces = F.regexp_extract_all("edits", F.lit("[UA]*[KDua](?:[UA]+$)?"), F.lit(0))
    edits = paths.select("block", F.posexplode(pieces)).select((F.col("block") + F.col("pos")).alias("row"), F.col("col").alias("piece"))
    each = ordered.join(edits, "row").select("conv", "row", "role", "text", F.posexplode(F.split("piece", "(?<=.)(?=.)"))).where("col <> 'D'")
    own = F.col("col").isin("K", "u", "a")
    named = F.when(F.col("col") == "K", F.col("role")).when(F.lower("col") == "u", "user").otherwise("assistant")
    turns = each.select("conv", "row", F.col("pos").alias("place"), named.alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"))
    return Repaired(summary, turns)


def digests(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): SHA-256 of `role:text` of all turns, newline-joined. Turns stream through the hash in order; none are gathered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, conv = None, None, None
        for b in batches:
            done = []
            for i, (k, line) in enumerate(zip(b.column(0), b.column(2).cast(pa.binary()), strict=True)):
                k = k.as_py()
                if k != key:
                    if key is not None:
                        done.append((conv, state.hexdigest()))
                    key, conv, state = k, b.column(1)[i].as_py(), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.as_py())
            yield rows(done)
        if key is not None:
            yield rows([(conv, state.hexdigest())])

    kind = turns.schema["conv"].dataType
    arrow = to_arrow_type(kind)

    def rows(done):
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], arrow), pa.array([h for _, h in done], pa.string())], names=["conv", "repaired_sha256"])

    lines = turns.select(key_of("conv").alias("ckey"), "conv", F.concat_ws(":", "role", "text").alias("line"), "row", "place")
    return lines.repartition("ckey").sortWithinPartitions("ckey", "row", "place").mapInArrow(run, f"conv {kind.simpleString()}, repaired_sha256 string")
