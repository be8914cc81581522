"""Machines whose next kept row is a function of the kept row: pointers instead of folds.

Debouncing, merging to a length and rate-limited alerts keep a first row, then the first later row that fulfils a condition on it, and so on.
Every row can therefore tell, without knowing whether it is kept, which row would be kept next. The kept rows are those that
the pointers reach from a key's first row. They are found in a fixed number of shuffles, however regular the input is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, laid
from .ordered import running, scan

CHUNK_ROWS = 65_536


def first_reaching(df: DataFrame, keys, value: str, n: str, target: Column, slot: float, name: str) -> DataFrame:
    """`df` with `name`: the least `n` of the key whose `value` is at least `target`, null where there is none.

    `value` must not fall as `n` grows. Rows and questions are put in one order by value and read in one scan, in slots of
    `slot` in value (and blocks of 4,096 slots), so no task holds a key.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"), F.lit(1).alias("__side"), F.col(n).alias("__n"), F.col(n).alias("__hit"))
    asked = df.select(*keys, target.cast("double").alias("__v"), F.lit(0).alias("__side"), F.col(n).alias("__n"), F.lit(None).cast("bigint").alias("__hit"))
    both = rows.unionByName(asked).withColumn("__slot", F.floor(F.col("__v") / slot)).withColumn("__wide", F.floor(F.col("__slot") / 4096))
    told = scan(both, keys, ["__v", "__side", "__n"], {name: running("first_after", "__hit")}, [["__wide"], ["__wide", "__slot"]])
    return df.join(told.where("__side = 0").select(*keys, F.col("__n").alias(n), name), [*keys, n])


def _frames(parts: Iterator[pd.DataFrame], where: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole chunks from sorted frames; a chunk has a bounded number of rows."""
    held = []
    for pdf in parts:
        if not len(pdf):
            continue
        if held and (held[-1][where].iloc[-1] != pdf[where].iloc[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        others = np.flatnonzero((pdf[where] != pdf[where].iloc[-1]).any(axis=1).to_numpy())
        at = others[-1] + 1 if len(others) else 0
        if at:
            yield pd.concat([*held, pdf.iloc[:at]], ignore_index=True)
            held = []
        held.append(pdf.iloc[at:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _inside(rows: pd.DataFrame, where: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, pd.DataFrame, np.ndarray]:
    """(rows of whole chunks, n that each points to, place of that in the same chunk or -1, questions, their places or -1 where the key has no such row), all chunks at once."""
    number = (rows[where] != rows[where].shift()).any(axis=1).to_numpy().cumsum() - 1
    real = rows["__row"].to_numpy() == 1
    own, asked, n = rows[real], rows[~real], rows["n"].to_numpy()
    first, size = np.zeros(number[-1] + 1, np.int64), np.bincount(number[real], minlength=number[-1] + 1)
    start = size.cumsum() - size
    at = np.flatnonzero(real)[start[size > 0]]
    first[size > 0] = n[at]

    def place(to, of):
        to = np.asarray(to, np.int64)
        return np.where((to >= first[of]) & (to < first[of] + size[of]), start[of] + to - first[of], -1)

    to = own["next"].to_numpy()
    return own, to, place(to, number[real]), asked, place(asked["n"], number[~real])


def exits(to: np.ndarray, place: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Where the pointers of chunks lead from each entry: the first n beyond the chunk, -1 for none. By doubling: jumps of 1, 2, 4, ... rows at once."""
    last, jump = np.arange(len(place)), place
    while (jump >= 0).any():
        last = np.where(jump >= 0, last[jump], last)
        jump = np.where(jump >= 0, jump[jump], -1)
    return to[last[entries]]


def reached(place: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Whether the pointers of chunks reach each row from one of `entries`, by doubling."""
    hit, jump = np.zeros(len(place), bool), place
    hit[entries] = True
    while (jump >= 0).any():
        to = jump[hit]
        hit[to[to >= 0]] = True
        jump = np.where(jump >= 0, jump[jump], -1)
    return hit


def orbit(df: DataFrame, keys, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """`df` with `kept`: whether the pointers reach the row from its key's first row.

    df: keys, n (dense from 0 inside a key), next (n of the row to keep next if this one is kept, always larger; null for none, as is one beyond the last row) and other columns.
    Rows are cut into chunks by n. Only rows that a pointer from another chunk reaches can be entries; every chunk gives its exit for each of its entries, the exits
    are chained over a key from its first row, and each chunk is then filled in from the entry that was reached.
    """
    keys = list(keys)
    others = [c for c in df.columns if c not in (*keys, "n", "next")]
    rows = cut(df.select(*keys, F.floor(F.col("n") / chunk_rows).alias("chunk"), "n", F.coalesce("next", F.lit(-1)).cast("bigint").alias("next"), *others))
    where = [*keys, "chunk"]
    at = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in where)
    target = F.floor(F.col("next") / chunk_rows)
    entries = rows.where(target > F.col("chunk")).select(*keys, target.alias("chunk"), F.col("next").alias("n")).union(rows.where("n = 0").select(*where, "n")).distinct()

    def marked(marks: DataFrame, columns) -> DataFrame:
        own = rows.select(*where, "n", "next", F.lit(1).alias("__row"), *columns)
        asked = marks.select(*where, "n", F.lit(-1).cast("bigint").alias("next"), F.lit(0).alias("__row"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns])
        return laid(own.unionByName(asked), where, ["n", "__row"])

    def ends(parts):
        for rows in _frames(parts, where):
            _, to, place, asked, entries = _inside(rows, where)
            asked = asked[entries >= 0]  # a pointer may lead beyond the last row
            if len(asked):
                yield asked[where].assign(entry=asked["n"], exit=exits(to, place, entries[entries >= 0]))

    def chain(parts):
        at, now = None, 0
        for pdf in parts:  # one row per entry of a chunk, in order; an exit lies behind all entries of its chunk
            made = []
            for *key, chunk, entry, exit_ in pdf.itertuples(index=False, name=None):
                if key != at:
                    at, now = key, 0
                if entry == now:
                    made.append((*key, chunk, entry))
                    now = exit_
            yield pd.DataFrame(made, columns=[*where, "n"])

    def fill(parts):
        for rows in _frames(parts, where):
            own, _, place, _, entries = _inside(rows, where)
            yield own[[*keys, "n", *others]].assign(kept=reached(place, entries[entries >= 0]))

    found = marked(entries, []).mapInPandas(ends, f"{at}, entry bigint, exit bigint")
    starts = laid(found.select(*where, "entry", "exit"), keys, ["entry"]).mapInPandas(chain, f"{at}, n bigint")
    out = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*keys, "n", *others])
    return marked(starts, others).mapInPandas(fill, f"{out}, kept boolean")
