"""Turns of conversations in order, spread so that a long conversation lies in several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, saved

#: White space that is taken off, as `rtrim` wants it.
BLANKS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NOT_SPACE}+")).cast("long")


def key_of(*cols: str | Column) -> Column:
    """A string that two rows share just when all `cols` are equal, null being a value of its own."""
    return F.to_json(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(cols)]))


def in_order(rows: DataFrame, conv: str, turn: str, role: str, text: str, null: str = " ") -> DataFrame:
    """(conv, turn, role, text, row, part), written: sorted by conversation, turn (null first), role and text. Null roles and texts are `null`.

    `row` follows that order over the whole table and is dense inside a `part`, one range of the order. Ranges hold about equally many rows,
    whatever the sizes of the conversations are; of a text, the range bounds look at the first signs only, so none travels to the driver whole.
    """
    picked = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(null)).alias("role"),
                         F.coalesce(F.col(text).cast("string"), F.lit(null)).alias("text"))
    dealt = picked.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")
    return saved(dealt.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)), "turns")
