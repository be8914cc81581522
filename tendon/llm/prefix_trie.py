"""Prefix trie of conversations: ternary search trees per range of the sorted sequences, merged where ranges meet."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import counted, saved, with_groups
from .ternary import TernaryTree
from .turns import key_of, word_count

#: Turns of distinct conversations that one tree is meant for.
SHARD_TURNS = 200_000
#: Ids whose text is joined at a time for the digest of the conversations that end at a node.
ID_CHUNK = 65_536
NODE = "key string, up string, top long, depth long, n long, least long, children long, leaves long, saved long, words long, digest string, above long"
NAMES = ("key", "up", "top", "depth", "n", "least", "children", "leaves", "saved", "words", "digest", "above")
_TYPES = [pa.string() if kind == "string" else pa.int64() for kind in (f.split()[1] for f in NODE.split(", "))]
NO_IDS = hashlib.sha256(b"").hexdigest()


def coded(rows: DataFrame, conv: str, turn: str, role: str, text: str, convs: DataFrame | None) -> DataFrame:
    """(conv, seq, words): the dictionary codes of every conversation's turns in order, and the words of each."""
    def known(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    turns = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.md5(key_of(known(role), known(text))).alias("mark"),
                                                       word_count(known(text)).alias("words"))
    turns = saved(turns.withColumn("spread", F.monotonically_increasing_id()), "turns")
    dictionary = saved(turns.groupBy("mark").agg(F.max("words").alias("w"), F.count(F.lit(1)).alias("uses")).withColumn("code", F.monotonically_increasing_id()), "dictionary")
    told = with_groups(turns, dictionary, ["mark"], ["code"], "uses", turns.count(), "spread")
    item = F.struct("turn", "mark", "code", "words")
    seqs = told.groupBy("conv").agg(F.array_sort(F.collect_list(item)).alias("t"))  # codes only; a conversation is one row
    if convs is not None:
        seqs = convs.join(seqs, "conv", "left")
    empty = F.array().cast("array<bigint>")
    return seqs.select("conv", F.coalesce(F.transform("t", lambda x: x["code"]), empty).alias("seq"), F.coalesce(F.transform("t", lambda x: x["words"]), empty).alias("words"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(same, conv) in order to (same, first, ids): comma-joined runs of ids of one group."""
    key, held = None, []

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], names=["same", "first", "ids"])

    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != key or len(held) >= ID_CHUNK:
                if held:
                    yield row()
                key, held = k, []
            held.append(c)
    if held:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(same, first, ids) in order to (same, least, digest); ids stream through the hash."""
    key, state, least = None, None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([least], pa.int64()), pa.array([state.hexdigest()])], names=["same", "least", "digest"])

    for b in batches:
        for k, first, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != key:
                if key is not None:
                    yield row()
                key, state, least = k, hashlib.sha256(), first
            else:
                state.update(b",")
            state.update(ids.encode())
    if key is not None:
        yield row()


def _together(run):
    """Gather the single rows of `run` into batches."""
    def inner(batches):
        held = []
        for b in run(batches):
            held.append(b)
            if len(held) == 4096:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return inner


def _name(ids: list[int]) -> str:
    return hashlib.blake2b(b",".join(b"%d" % i for i in ids), digest_size=16).hexdigest() if ids else ""


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards, sorted by (shard, pos), to the rows of their nodes."""
    shard, held, reach = None, [], (0, 0)

    def nodes():
        tree, shared, tops = TernaryTree.of(held), {0: ""}, {0: None}
        for ids, depth in ((held[0][0], reach[0]), (held[-1][0], reach[1])):
            for d, x in enumerate(tree.path(ids[:depth])):
                shared[x], tops[x] = _name(ids[:d]), ids[0] if d else None
        made = tree.sums(shared)
        top = {name: tops[x] for x, name in shared.items()}
        for at in range(0, len(made), 10_000):
            part = made[at:at + 10_000]
            for m in part:
                m["top"] = top.get(m["key"])
            yield pa.RecordBatch.from_arrays([pa.array([m[c] for m in part], t) for c, t in zip(NAMES, _TYPES, strict=True)], names=list(NAMES))

    for b in batches:
        for s, ids, words, n, least, digest, left, right in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if s != shard:
                if held:
                    yield from nodes()
                shard, held, reach = s, [], (left, right)
            held.append((ids, words, n, least, digest))
    if held:
        yield from nodes()


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """Shared prefixes under one first turn, each once: what lies below is added, the deepest first."""
    rows = group.sort_values("depth", ascending=False).to_dict("records")
    at = {r["key"]: r for r in rows}
    for r in rows:
        r["leaves"] = r["leaves"] or 1
        r["saved"] += (r["n"] - 1) * r["words"]
        above = at.get(r["up"])
        if above is not None:
            above["children"] += 1
            above["leaves"] += r["leaves"]
            above["saved"] += r["saved"]
    return pd.DataFrame(rows, columns=group.columns)


def prefix_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", convs: DataFrame | None = None, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of all conversations: a distinct sequence of first turns (role, text), from the root at depth 0.

    conv_id is the smallest member, parent_conv_id that of the parent (null at the root); n_convs members; n_children; n_leaves childless nodes below, itself
    included; saved_tokens the sum below, itself included, of (members - 1) * words of the last turn; ends_sha256 the SHA-256 of the ascending, comma-joined ids that end here.

    Turns become codes of a dictionary. Equal sequences are one entry, whatever the number of their conversations. Distinct sequences are sorted
    into ranges; each range is one ternary search tree, whose nodes are summed without recursion. Only prefixes that two neighbouring ranges share are left open: they are summed
    over ranges, then bottom-up inside each first turn, and the root last. Those are few: ranges times the length of what neighbours share.

    Turns go by number (null first), ties by the MD5 of role and text. Null roles and texts are empty. Rows without a conversation id belong to none and are left out. Repeated rows are turns
    of their own. `convs` (conv) may name further conversations, which may have no turns; they end at the root. An empty table gives no rows. Other columns are not looked at.
    A conversation is one row of codes, eight bytes a turn, whatever the length of its texts, which are hashed where they lie.
    """
    spark = rows.sparkSession
    seqs = saved(coded(rows, conv, turn, role, text, convs).withColumn("same", F.md5(F.to_json(F.struct("seq")))), "sequences")
    ids = seqs.select("same", "conv").repartitionByRange("same", "conv").sortWithinPartitions("same", "conv").mapInArrow(_together(_chunks), "same string, first long, ids string")
    ends = ids.repartition("same").sortWithinPartitions("same", "first").mapInArrow(_together(_hashed), "same string, least long, digest string")
    distinct = seqs.groupBy("same").agg(F.first("seq").alias("seq"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n")).join(ends, "same").drop("same")
    turns = seqs.agg(F.coalesce(F.sum(F.size("seq")), F.lit(0))).first()[0]
    parts = max(turns // shard_turns + 1, spark.sparkContext.defaultParallelism if shard_turns == SHARD_TURNS else 1)
    sorted_ = distinct.repartitionByRange(parts, "seq").sortWithinPartitions("seq")
    shards = saved(sorted_.select(F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("pos"), "seq", "words", "n", "least", "digest"), "shards")

    ranges = shards.groupBy("shard").agg(F.min_by("seq", "pos").alias("first"), F.max_by("seq", "pos").alias("last"))
    w = Window.orderBy("shard")  # one row per range

    def common(a, b):
        return F.coalesce(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)) - 1, F.lit(0)).cast("long")

    reach = ranges.select("shard", common(F.lag("last").over(w), F.col("first")).alias("left"), common(F.col("last"), F.lead("first").over(w)).alias("right"))
    dealt = shards.join(counted(reach), "shard").repartition("shard").sortWithinPartitions("shard", "pos")
    nodes = saved(dealt.select("shard", "seq", "words", "n", "least", "digest", "left", "right").mapInArrow(_trees, NODE), "nodes")

    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    open_ = nodes.where("key <> ''").groupBy("key").agg(*[F.first(c).alias(c) for c in ("up", "top", "depth", "words")], *sums, F.min("least").alias("least"), F.max("digest").alias("digest"))
    names = [c for c in NAMES if c != "above"]
    shared = saved(open_.select(*names).groupBy("top").applyInPandas(_merge, NODE.removesuffix(", above long")), "shared")
    below = shared.where("depth = 1").agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("l"), F.coalesce(F.sum("saved"), F.lit(0)).alias("s"))
    top = nodes.where("key = ''").agg(*sums, F.min("least").alias("least"), F.max("digest").alias("digest")).where("n > 0")
    root = top.crossJoin(F.broadcast(below)).select(  # one row each
        F.lit("").alias("key"), F.lit(None).cast("string").alias("up"), F.lit(None).cast("long").alias("top"), F.lit(0).cast("long").alias("depth"), "n", "least", (F.col("children") + F.col("c")).alias("children"),
        F.greatest(F.col("leaves") + F.col("l"), F.lit(1)).alias("leaves"), (F.col("saved") + F.col("s")).alias("saved"), F.lit(0).cast("long").alias("words"), "digest")
    merged = saved(shared.unionByName(root), "merged")
    parents = counted(merged.select(F.col("key").alias("__key"), F.col("least").alias("__least")))
    out = ["depth", "n", "least", "children", "leaves", "saved", "digest"]
    inner = nodes.where("key IS NULL")
    rest = inner.where("up IS NULL").select(*out, "above").union(inner.where("up IS NOT NULL").join(parents, F.col("up") == F.col("__key")).select(*out, "__least"))
    every = rest.union(merged.join(parents, F.col("up") == F.col("__key"), "left").select(*out, "__least"))
    return every.select(F.col("least").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
                        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("digest", F.lit(NO_IDS)).alias("ends_sha256"))
