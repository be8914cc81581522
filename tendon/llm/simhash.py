"""SimHash near-duplicates through an inverted index of byte positions with count filtering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .common import saved, with_groups
from .components import components
from .words import shingles

BYTES = 8
#: Members up to which the pairs of a posting are compared one by one; larger postings are linked by neighbours in common.
CROWD = 64


def hashed(text: bytes | None, width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, repeats included, block by block."""
    import xxhash
    digest = xxhash.xxh64_intdigest
    for part in shingles(text or b"", width):
        yield np.fromiter((digest(s, seed) for s in part), np.uint64, len(part))


def majority(parts: Iterable[np.ndarray]) -> int:
    """Bit i is 1 if it is set in over half of the hashes; zero without any."""
    total, tally = 0, np.zeros(64, np.int64)
    for h in parts:
        tally += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(2 * tally > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprint(text: bytes | None, width: int, seed: int) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64; zero without words."""
    return majority(hashed(text, width, seed))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, seed: int) -> DataFrame:
    """(__id, fp) per row; fp is the signed reading of the 64 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = np.array([fingerprint(t.as_py(), width, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["__id", "fp"])

    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("t"))
    return source.mapInArrow(run, f"__id {source.schema['__id'].dataType.simpleString()}, fp long")


def byte_sets(bits: int) -> list[int]:
    """Masks of byte positions to index together, so that two fingerprints that differ in at most `bits` bits agree in at least one.

    `bits` bits lie in at most `bits` bytes; a mask leaves out bits + 1 positions, and the sets left out cover
    every choice of `bits` positions. Picked greedily.
    """
    open_ = set(combinations(range(BYTES), bits))
    choices = list(combinations(range(BYTES), bits + 1))
    masks = []
    while open_:
        best = max(choices, key=lambda c: sum(x in open_ for x in combinations(c, bits)))
        open_ -= set(combinations(best, bits))
        masks.append(sum(255 << (8 * i) for i in range(BYTES) if i not in best))
    return masks


def _verified(fps: np.ndarray, which: int, masks: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside one posting, each only in the first posting that its two members share."""
    i, j = np.triu_indices(len(fps), 1)
    x = fps[i] ^ fps[j]
    shared = (x[:, None] >> np.arange(0, 64, 8, dtype=np.uint64) & np.uint64(255) == 0).sum(1)
    keep = shared >= BYTES - bits  # fewer shared bytes cannot be within `bits` bits
    i, j, x = i[keep], j[keep], x[keep]
    keep = np.bitwise_count(x) <= bits
    for m in masks[:which]:
        keep &= (x & m) != 0
    return fps[i[keep]], fps[j[keep]]


def _scan(masks: list[int], bits: int, crowd: int):
    """Over rows sorted by (which, key, fp): links of small postings; members of crowded ones with v null."""
    table = np.array(masks, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, crowded = None, [], False
        for b in batches:
            which, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            fps = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero((np.diff(which) != 0) | (np.diff(keys) != 0)) + 1
            u, v, many = [], [], []
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(fps)], strict=True):
                now = (which[lo], keys[lo])
                if now != key:
                    if len(held) > 1:
                        a, c = _verified(np.array(held, np.uint64), key[0], table, bits)
                        u.append(a), v.append(c)
                    key, held, crowded = now, [], False
                if hi - lo == 1 and not held and not crowded and hi < len(fps):
                    continue  # alone in its posting
                if not crowded and len(held) + hi - lo > crowd:
                    many.append(np.array(held, np.uint64))
                    held, crowded = [], True
                many.append(fps[lo:hi]) if crowded else held.extend(fps[lo:hi])
            yield _rows(u, v, many)
        if len(held) > 1:
            a, c = _verified(np.array(held, np.uint64), key[0], table, bits)
            yield _rows([a], [c], [])

    def _rows(u, v, many):
        a, c, m = (np.concatenate([np.empty(0, np.uint64), *x]).view(np.int64) for x in (u, v, many))
        right = pa.concat_arrays([pa.array(c), pa.nulls(len(m), pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, m])), right], names=["u", "v"])

    return run


def links(fps: DataFrame, bits: int, crowd: int = CROWD) -> DataFrame:
    """Links (u, v) that join all fingerprints of `fps` (distinct, column fp) within `bits` bits of one another.

    Small postings give every pair. In a crowded posting the members are indexed by all values at one bit's distance:
    two members are within two bits just when they share such a value, and at most 65 members share one, so they are tied to
    the smallest there. That is linear in the posting, and joins the same fingerprints. (For more than two bits all pairs are taken.)
    """
    masks = byte_sets(bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    postings = (fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                                    for i, m in enumerate(signed)])).alias("p"))
                .select("p.which", "p.key", "fp").repartition("which", "key").sortWithinPartitions("which", "key", "fp"))
    found = saved(postings.mapInArrow(_scan(masks, bits, crowd if bits == 2 else 1 << 62), "u long, v long"), "links")
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(64)])
    near = (found.where("v IS NULL").select("u").distinct().select("u", F.explode(flips).alias("f"))
            .groupBy(F.col("u").bitwiseXOR(F.col("f")).alias("middle")).agg(F.collect_set("u").alias("us")).where("size(us) > 1")
            .select(F.explode("us").alias("u"), F.array_min("us").alias("v")).where("u <> v"))
    return found.where("v IS NOT NULL").union(near.distinct())


def with_components(each: DataFrame, fps: DataFrame, found: DataFrame) -> DataFrame:
    """`each` (__id, fp) with the smallest id, component_id, that its fingerprint reaches over the links `found`; `fps` holds each fp with its `least` id and `rows`."""
    labels = components(found)
    named = cut(fps.select("fp", "least").join(labels.withColumnRenamed("node", "fp"), "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("c"))
    reached = cut(fps.select("fp", "least", "rows").join(named.join(least, "label").select("fp", "c"), "fp", "left").select("fp", "rows", F.coalesce("c", "least").alias("component_id")))
    return with_groups(each, reached, ["fp"], ["component_id"], "rows", each.count(), "__id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 2, seed: int = 42) -> DataFrame:
    """The id, fingerprint (16 hex digits) and component_id of every row of `docs`.

    A-Z are lower-cased, words are split at ASCII white space, shingles of `width` words keep their repeats; a text of fewer
    words is one shingle; a text without words, or null, has fingerprint zero and is linked like any other. Two rows are linked
    when their fingerprints differ in at most `bits` bits, and component_id is the smallest id that a row can reach.

    Equal fingerprints are grouped first, so a group of copies is one entry of the index however many rows it has. Links and
    components are made of distinct fingerprints only.

    Very long texts are read whole, block by block. An empty table gives no rows; rows that repeat an id each get their own row; a null id is never the smallest, and
    component_id is null where a component has no other. Other columns are not looked at.
    """
    each = saved(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    fps = cut(each.groupBy("fp").agg(F.min("__id").alias("least"), F.count(F.lit(1)).alias("rows")))
    return with_components(each, fps, links(fps.select("fp"), bits)).select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """`docs` without the rows whose component holds a smaller id. Rows without an id stay."""
    gone = near_dedup(docs, id_col, **how).where(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
