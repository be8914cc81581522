"""Exact deduplication in two passes over a Bloom filter, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .common import SPACE, text_of, with_groups, without

#: Bits in one block of the filter; Spark's bitmap functions use blocks of this size.
BLOCK = 32768
OUT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_of(name), f"{SPACE}+", " ")


def _spots(hashes: int) -> Column:
    """The places of a hash inside its block."""
    return F.array(*[F.pmod(F.xxhash64("__hash", F.lit(i)), F.lit(BLOCK)) for i in range(hashes)])


def _test(i: int) -> str:
    """SQL for: place `i` of the row is set in the bitmap of its block."""
    byte = f"substring(__bits, cast(__spots[{i}] div 8 AS int) + 1, 1)"
    return f"getbit(cast(conv(hex({byte}), 16, 10) AS int), cast(__spots[{i}] % 8 AS int)) = 1"


def repeated_filter(hashed: DataFrame, rows: int, bits_per_row: int, hashes: int, max_bits: int) -> tuple[DataFrame, int]:
    """First pass: bitmaps of the places that two or more rows hit, and the number of blocks.

    A hash that occurs twice hits all its places twice, so it is never missed. Rows are counted
    per place before the shuffle, so a third of all rows with one hash sends one row per task.
    """
    blocks = max(1, min(max_bits, 1 << max(0, math.ceil(math.log2(max(1, rows * bits_per_row))))) // BLOCK)
    hits = (hashed.select(F.pmod("__hash", F.lit(blocks)).alias("__block"), F.explode(F.array_distinct(_spots(hashes))).alias("__spot"))
            .groupBy("__block", "__spot").count().where("count > 1"))
    return hits.groupBy("__block").agg(F.expr("bitmap_construct_agg(__spot)").alias("__bits")), blocks


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bits_per_row: int = 16, hashes: int = 2, max_bits: int = 1 << 29) -> DataFrame:
    """Every row of `docs` with keep_id, group_size, kept and text_sha256.

    Texts are equal when they agree after each run of ASCII white space became one space; null
    counts as empty. Of equal texts the row with the smallest id stays (`kept`).

    The first pass builds a filter of hashes that may occur twice. In the second pass only rows
    that the filter lets through are shuffled and grouped by their SHA-256; all others are single
    and pass straight through. The filter takes `bits_per_row` bits a row, at most `max_bits`
    (64 MB), which bounds what is broadcast; a fuller filter lets more rows through and the result
    stays exact.

    Very long texts are hashed whole. An empty table gives no rows. Rows that repeat the smallest id of their group are all kept; a
    null id is never the smallest unless its whole group has none, and then keep_id is null.
    Input columns called like a result give way to it.
    """
    names = without(docs, *OUT)
    hashed = docs.withColumn("__text", normalised(text_col)).withColumn("__hash", F.xxhash64("__text"))
    rows = docs.count()
    found, blocks = repeated_filter(hashed.select("__hash"), rows, bits_per_row, hashes, max_bits)
    told = (hashed.withColumn("__block", F.pmod("__hash", F.lit(blocks))).withColumn("__spots", _spots(hashes))
            .join(F.broadcast(cut(found)), "__block", "left")
            .withColumn("__maybe", F.coalesce(F.expr(" AND ".join(_test(i) for i in range(hashes))), F.lit(False)))
            .withColumn("text_sha256", F.sha2("__text", 256)))
    maybe = told.where("__maybe")
    groups = cut(maybe.groupBy("text_sha256").agg(F.min(id_col).alias("__keep"), F.count(F.lit(1)).alias("__n")))
    held = (with_groups(maybe.select(*names, "text_sha256"), groups, ["text_sha256"], ["__keep", "__n"], "__n", rows, id_col)
            .select(*names, F.col("__keep").alias("keep_id"), F.col("__n").alias("group_size"),
                    F.col(id_col).eqNullSafe(F.col("__keep")).alias("kept"), "text_sha256"))
    single = told.where("NOT __maybe").select(*names, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                              F.lit(True).alias("kept"), "text_sha256")
    return held.unionByName(single)
