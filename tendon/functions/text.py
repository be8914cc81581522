"""Prompt text: clean-up, label ids, collapsed decodings, error rates."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col

# ---- fixed values: ordered vocabulary, replacements, and letters and signs without a decomposition ----
VOCABULARY = [*string.ascii_letters, *string.digits, *string.punctuation, "⌫", "⏎", " ", "⇧", "🤏"]
REPLACED = {"\n": "⏎", "\r": "⏎", "\b": "⌫", "’": "'", "“": '"', "”": '"', "—": "-"}
PLAIN = {"Ø": "O", "ø": "o", "Ł": "L", "ł": "l", "Đ": "D", "đ": "d", "‘": "'", "–": "-", "‐": "-", "\u00a0": " "}
KEY_SYMBOLS = {"→": "_", "←": "⌫", "↑": "⇧", "⇡": "⇧"}  # shown arrows and the keys they stand for
# -------------------------------------------------------------------------------------------------------


def _folding() -> dict[str, str]:
    """What each character becomes: marked Latin letters the plain letter under them, by the Unicode decomposition, and the fixed replacements."""
    marked = {chr(n): unicodedata.normalize("NFD", chr(n))[0] for n in range(0xC0, 0x2000)}
    return {a: b for a, b in marked.items() if b in string.ascii_letters} | PLAIN | REPLACED | KEY_SYMBOLS


FOLDED = _folding()


def clean_text(c) -> Column:
    """Replace and fold in one pass, then drop every character outside the vocabulary."""
    keep = "".join("\\" + ch if ch in string.punctuation else ch for ch in VOCABULARY)
    return F.regexp_replace(F.translate(col(c), "".join(FOLDED), "".join(FOLDED.values())), f"[^{keep}]", "")


def characters(c) -> Column:
    return F.filter(F.split(col(c), ""), lambda x: x != "")


def encode_text(c) -> Column:
    """Positions of the characters in the vocabulary (cleaned text)."""
    ids = F.create_map(*[F.lit(x) for i, ch in enumerate(VOCABULARY) for x in (ch, i)])
    return F.transform(characters(c), lambda x: F.try_element_at(ids, x))


def decode_text(ids) -> Column:
    chars = F.array(*[F.lit(ch) for ch in VOCABULARY])
    return F.array_join(F.transform(col(ids), lambda i: F.get(chars, i.cast("int"))), "")


def greedy_collapse(df: DataFrame, keys, order: str, label: str, previous: str, blank: int, text) -> DataFrame:
    """Join the labels of each sequence after dropping blanks and repeats.

    `previous` is the label of the row before. The output of a sequence is one string by definition.
    """
    kept = df.where((F.col(label) != blank) & (F.col(previous).isNull() | (F.col(previous) != F.col(label))))
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text(F.col(label)).alias("t"))))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(items, lambda s: s["t"]), "").alias("text"))
