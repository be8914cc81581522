"""Near copies by the Jaccard index of their word shingles: the fingerprints of op 5 find candidates, min-wise bands what these miss, and exact sets verify both."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted, remove, saved
from .components import components
from . import simhash
from .simhash import hashed, with_components

#: Bands, and min-wise hashes in each. A pair at 0.8 shares a band with probability 1 - (1 - 0.8^5)^24 = 0.99993, one at 0.9 with 1 - 5e-10.
BANDS, ROWS = 24, 5
#: Members up to which all pairs of different components in a bucket are looked at; larger ones are tied to two members, then joined by rare shingles.
CROWD = 8
#: Chance that a pair at the threshold is dropped by its signature.
LOSS = 1e-6
#: Texts that are compared with one hub in one task.
TOGETHER = 256


def shingle_set(text: bytes | None, width: int, seed: int = 42) -> np.ndarray:
    """Sorted XXH64 of the distinct shingles."""
    return _distinct(hashed(text, width, seed))


def _distinct(parts: Iterable[np.ndarray]) -> np.ndarray:
    parts = [np.unique(h) for h in parts]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
    return a | np.uint64(1), b


def sketch(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key for each band, made of the band's number and its least hashes, and the last byte of every least hash."""
    import xxhash
    least = np.full(len(a), (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        x = (hashes[at:at + 2048, None] ^ b) * a
        np.minimum(least, (x ^ x >> np.uint64(32)).min(0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64), least.astype(np.uint8).tobytes()


def fewest(percent: int) -> int:
    """Equal bytes that two signatures have at `percent` hundredths, but for a chance of LOSS."""
    n, p, chance = BANDS * ROWS, percent / 100, 0.0
    for k in range(n + 1):
        chance += comb(n, k) * p**k * (1 - p)**(n - k)
        if chance > LOSS:
            return k
    return n


def _mark() -> Column:
    return F.md5(F.coalesce(F.col("t"), F.lit("")))


def _sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(__id, mark, print, fp, n, keys, sig) per row: mark is the text's MD5, print its fingerprint by op 5, fp stands for the set of shingles, n is its size; a text without words has fp 0 and no keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        a, b = _factors()
        for batch in batches:
            prints, fps, sizes, keys, sigs = [], [], [], [], []
            for t in batch.column(2).cast(pa.binary()):
                parts = list(hashed(t.as_py(), width, 42))
                prints.append(simhash.majority(parts))
                s = _distinct(parts)
                fps.append(xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0)
                sizes.append(len(s))
                k, sig = sketch(s, a, b) if len(s) else (np.empty(0, np.uint64), b"")
                keys.append(k.view(np.int64))
                sigs.append(sig)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (prints, fps)], pa.array(sizes, pa.int64()),
                                              pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["__id", "mark", "print", "fp", "n", "keys", "sig"])

    source = _texts(docs, id_col, text_col)
    return source.mapInArrow(run, f"__id {source.schema['__id'].dataType.simpleString()}, mark string, print long, fp long, n long, keys array<long>, sig binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("t")).select("__id", _mark().alias("mark"), "t")


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, fp) in order to those of buckets that hold two or more."""
    first = None
    told = False
    for b in batches:
        if not b.num_rows:
            continue
        keys, sizes, fps = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = np.flatnonzero(np.diff(keys)) + 1
        out = [np.empty((0, 3), np.int64)]
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True):
            if first is None or keys[lo] != first[0]:
                first, told = (keys[lo], sizes[lo], fps[lo]), hi - lo > 1
                if not told:
                    continue
            elif not told:  # the first one stood at the end of the batch before
                out.append(np.array([first], np.int64))
                told = True
            out.append(np.column_stack([keys[lo:hi], sizes[lo:hi], fps[lo:hi]]))
        rows = np.concatenate(out)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, i].copy(), pa.int64()) for i in range(3)], names=["key", "n", "fp"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, t) without the texts of a fingerprint that the task has passed on already."""
    seen: set[int] = set()
    for b in batches:
        fps = b.column(0).to_pylist()
        keep = []
        for i, fp in enumerate(fps):
            if fp not in seen:
                seen.add(fp)
                keep.append(i)
        yield b.take(pa.array(keep, pa.int64()))


def _alike(fewest: int):
    """(u, v, su, sv) to those pairs (u, v) whose signatures agree in `fewest` bytes or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
            yield b.select(["u", "v"]).filter(pa.array((x == y).sum(1) >= fewest)) if b.num_rows else b.select(["u", "v"])

    return run


def _compare(width: int, percent: int):
    """Rows (hub, salt, place, fp, t) in order, the hub's text first: pairs (u, v) of a text and its hub whose sets of shingles reach `percent`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = None, None
        for b in batches:
            u, v = [], []
            for hub, salt, place, fp, t in zip(*b.columns, strict=True):
                s = shingle_set(t.as_py(), width)
                if place.as_py() == 0:
                    at, base = (hub.as_py(), salt.as_py()), s
                elif (hub.as_py(), salt.as_py()) == at:
                    both = len(np.intersect1d(base, s, assume_unique=True))
                    if 100 * both >= percent * (len(base) + len(s) - both):
                        u.append(fp.as_py())
                        v.append(at[0])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


@dataclass
class Verifier:
    """Verifies pairs of fingerprints: by signature, then by the exact sets of their texts, each text sent once to each hub that it is compared with."""

    sigs: DataFrame
    texts: DataFrame
    width: int
    percent: int

    def __post_init__(self):
        self.tested: DataFrame | None = None

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of `pairs` (u, v) that reach the threshold. Pairs that were asked before are not tested again."""
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["u", "v"], "left_anti")
        pairs = saved(pairs, "pairs")
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        both = pairs.join(self.sigs.withColumnsRenamed({"fp": "u", "sig": "su"}), "u").join(self.sigs.withColumnsRenamed({"fp": "v", "sig": "sv"}), "v")
        likely = saved(both.select("u", "v", "su", "sv").mapInArrow(_alike(fewest(self.percent)), "u long, v long"), "likely")
        ends = likely.select(F.col("u").alias("fp")).union(likely.select("v")).groupBy("fp").agg(F.count(F.lit(1)).alias("c"))
        # the end that more pairs share is the hub
        ranked = likely.join(ends.withColumnsRenamed({"fp": "u", "c": "cu"}), "u").join(ends.withColumnsRenamed({"fp": "v", "c": "cv"}), "v")
        turned = saved(ranked.select(F.when(F.col("cu") > F.col("cv"), F.col("u")).otherwise(F.col("v")).alias("hub"), F.when(F.col("cu") > F.col("cv"), F.col("v")).otherwise(F.col("u")).alias("fp")), "turned")
        parts = counted(turned.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("long").alias("parts")))
        asked = turned.join(parts, "hub").select("hub", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("salt"), F.lit(1).alias("place"), "fp")
        asked = asked.union(parts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("place"), F.col("hub").alias("fp")))
        sent = asked.join(self.texts, "fp").select("hub", "salt", "place", "fp", F.col("t").cast("binary").alias("t"))
        return saved(sent.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "place").mapInArrow(_compare(self.width, self.percent), "u long, v long"), "linked")


def _rare_pairs(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (u, v) of different labels among `members` (fp, n, label) that may reach `percent`: they share one of the rarest shingles of both.

    Of n shingles, in any order that all texts use, the first n - ceil(percent * n) + 1 hold one that two such sets have in common. Rarest first,
    a passage that many texts share is not among them. The first shingle in common also leaves enough behind it in both texts, so a group of texts
    that share much, but too little, gives no pairs.
    """
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fp, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                s = shingle_set(t.as_py(), width).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), fp, np.int64)), pa.array(s)], names=["fp", "s"])

    held = saved(members.select("fp").join(texts, "fp").select("fp", "t").mapInArrow(explode, "fp long, s long"), "shingles")
    often = held.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ranked = held.join(often, "s", "left").select("fp", F.struct(F.coalesce("c", F.lit(1)).alias("c"), "s").alias("x"))
    size = F.size("xs")
    first = ranked.groupBy("fp").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # one text's shingles
    first = first.select("fp", F.posexplode(F.slice("xs", F.lit(1), size - F.ceil(size * percent / 100).cast("int") + 1)).alias("place", "x")).where("x.c > 1").select("fp", "x.s", "place")
    told = saved(first.join(members, "fp").select("s", "fp", "n", "label", (F.col("n") - F.col("place")).alias("rest")), "rare")
    a, b = told.alias("a"), told.alias("b")
    shares = F.least("a.rest", "b.rest") * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent  # what both can share from here on
    both = (F.col("a.s") == F.col("b.s")) & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.label") != F.col("b.label")) & shares
    return a.join(b, both).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def joined(labels: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """(fp, label) after the links `fresh` (u, v): only the links between different components are followed, so later turns cost what they add."""
    if labels is None:
        return saved(components(fresh).withColumnRenamed("node", "fp"), "labels")
    known = labels.withColumnsRenamed({"fp": "node", "label": "own"})
    ends = fresh.join(known.withColumnsRenamed({"node": "u", "own": "lu"}), "u", "left").join(known.withColumnsRenamed({"node": "v", "own": "lv"}), "v", "left")
    between = saved(ends.select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v")).where("u <> v"), "between")
    if between.isEmpty():
        return labels
    moved = components(between)
    old = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("fp", F.coalesce("to", "label").alias("label"))
    return saved(old.union(moved.join(labels, moved["node"] == labels["fp"], "left_anti")), "labels")


def fingerprint_pairs(prints: DataFrame, bits: int) -> DataFrame:
    """Pairs (u, v) of the sets in `prints` (print, fp) that op 5 links: those with one fingerprint, and one each of two fingerprints within `bits` bits."""
    heads = saved(prints.groupBy("print").agg(F.min("fp").alias("v")), "heads")
    same = prints.join(heads, "print").where("fp <> v").select(F.col("fp").alias("u"), "v")
    near = simhash.links(heads.select(F.col("print").alias("fp")), bits)
    ends = near.join(heads.select(F.col("print").alias("u"), F.col("v").alias("fu")), "u").join(heads.select(F.col("print").alias("v"), F.col("v").alias("fv")), "v")
    return same.union(ends.where("fu <> fv").select("fu", "fv")).distinct()


def unjoined(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of `pairs` (u, v) that lie in different components of `labels`."""
    known = labels.withColumnsRenamed({"fp": "u", "label": "lu"})
    ends = pairs.join(known, "u", "left").join(known.withColumnsRenamed({"u": "v", "lu": "lv"}), "v", "left")
    return ends.where("coalesce(lu, u) <> coalesce(lv, v)").select("u", "v")


def links(linked: DataFrame, found: DataFrame, verify: Verifier, crowd: int = CROWD) -> DataFrame:
    """Links (u, v) of all sets that reach the threshold and are a pair of `linked` (u, v) or share a bucket of `found` (key, n, fp), each to the smallest of its component.

    First the pairs that op 5 links by its fingerprints are verified. Then every fingerprint is compared with one hub, the one that most of its buckets name: a bucket names the member that shares buckets most often, so the text that copies were made from, where
    it is there. Then only pairs of different components count: all of them
    in small buckets, in crowded ones those with one more member. At last the members of crowded buckets that still differ are compared
    where they share a rare shingle, so nothing is lost.
    """
    percent = verify.percent
    met = found.join(found.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("others")), "key")
    ranked = saved(found.join(met.groupBy("fp").agg(F.sum("others").alias("degree")), "fp"), "degrees")
    heads = ranked.groupBy("key").agg(F.max_by(F.struct("fp", "n"), F.struct("degree", "fp")).alias("h")).select("key", F.col("h.fp").alias("hub"), F.col("h.n").alias("hn"))
    near = f"100 * least(n, hn) >= {percent} * greatest(n, hn)"
    hubs = ranked.join(heads, "key").where("fp <> hub").where(near).groupBy("fp", "hub").agg(F.count(F.lit(1)).alias("c"))
    labels = joined(None, verify.linked(linked))
    labels = joined(labels, verify.linked(unjoined(hubs.groupBy("fp").agg(F.max_by("hub", F.struct("c", "hub")).alias("v")).select(F.col("fp").alias("u"), "v"), labels)))
    fits = f"label <> hl AND 100 * least(n, hn) >= {percent} * greatest(n, hn)"

    def apart(left: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of `left` (key, n, fp) with their labels, and the keys that hold several, with their size and one member."""
        named = saved(left.join(labels, "fp", "left").select("key", "n", "fp", F.coalesce("label", "fp").alias("label")), "named")
        many = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("c"), F.min_by(F.struct("fp", "n", "label"), F.xxhash64(F.lit(5), "fp")).alias("h")).where("lo <> hi")
        return named, saved(many.select("key", "c", F.col("h.fp").alias("hub"), F.col("h.n").alias("hn"), F.col("h.label").alias("hl")), "many")

    named, many = apart(found.select("key", "n", "fp"))
    big = F.col("c") > crowd
    own = named.join(many.where(~big).select("key"), "key", "left_semi")
    pairs = own.join(own.selectExpr("key", "fp AS hub", "n AS hn", "label AS hl"), "key").where("fp < hub").where(fits).selectExpr("fp AS u", "hub AS v")
    pairs = pairs.union(named.join(many.where(big).drop("c"), "key").where("fp <> hub").where(fits).selectExpr("fp AS u", "hub AS v"))
    labels = joined(labels, verify.linked(pairs))
    left = saved(named.join(many.where(big).select("key"), "key", "left_semi").select("key", "n", "fp"), "left")
    if not left.isEmpty():
        named, many = apart(left)
        if not many.isEmpty():
            members = named.join(many.select("key"), "key", "left_semi").select("fp", "n", "label").distinct()
            labels = joined(labels, verify.linked(_rare_pairs(members, verify.texts, verify.width, percent)))
    return labels.select(F.col("fp").alias("u"), F.col("label").alias("v"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, crowd: int = CROWD, bits: int = 2) -> DataFrame:
    """The id and component_id of every row of `docs`: rows are linked when the Jaccard index of their sets of shingles is `percent` hundredths or more.

    Words are split at ASCII white space, A-Z lower-cased, repeats left out; fewer than `width` words are one shingle; texts without words, or null, are equal to one another.
    component_id is the smallest id that a row can reach. Equal sets are one entry, however many rows have them.

    Candidates are the pairs whose SimHash fingerprints op 5 links, at `bits` or fewer differing bits, through its index of byte positions. At 0.8 two fingerprints mostly differ in more bits,
    so min-wise bands look for what is left between the components made so far. Exact sets decide in both cases.

    Very long texts are read whole, block by block; a comparison holds the sets of two texts. A null id is never the smallest, and component_id is null where
    a component has no other. Rows that repeat an id, or repeat altogether, each get a row. An empty table gives no rows. Other columns are not looked at.
    The texts of `docs` are read twice: once for the sketches, once, written out, for the sets that are a candidate with another.
    """
    spark = docs.sparkSession
    each = saved(_sketches(docs, id_col, text_col, width), "sketches")
    fps = each.groupBy("fp").agg(F.min("__id").alias("least"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("mark", "__id")).alias("one"), *[F.first(c).alias(c) for c in ("n", "keys", "sig")])
    fps = saved(fps, "fingerprints")
    rows = saved(each.select("__id", "fp"), "rows")
    prints = saved(each.where("n > 0").select("print", "fp").distinct(), "prints")
    remove(spark, each.scratch)
    near = saved(fingerprint_pairs(prints, bits), "near")
    postings = fps.select(F.explode("keys").alias("key"), "n", "fp").repartition("key").sortWithinPartitions("key", "n", "fp")
    found = saved(postings.mapInArrow(_open, "key long, n long, fp long"), "buckets")
    named = found.select("fp").union(near.select("u")).union(near.select("v")).distinct()
    wanted = counted(fps.join(named, "fp", "left_semi").select("fp", F.col("one.mark").alias("__mark"), F.col("one.__id").alias("__one")))
    same = (F.col("mark") == F.col("__mark")) & F.col("__id").eqNullSafe(F.col("__one"))
    texts = _texts(docs, id_col, text_col).join(wanted, same).select("fp", "t").mapInArrow(_once, "fp long, t string")
    verify = Verifier(fps.select("fp", "sig"), saved(texts, "texts"), width, percent)
    return with_components(rows, fps.select("fp", "least", "rows"), links(near, found, verify, crowd)).select(F.col("__id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """`docs` without the rows whose component holds a smaller id. Rows without an id stay."""
    gone = counted(groups(docs, id_col, **how).where(F.col("component_id") < F.col(id_col)).select(id_col).distinct())
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
