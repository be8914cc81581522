"""Linear recurrences over long sequences: an associative scan of affine maps.

A linear filter takes a chunk's entry state s to A^rows s + e, where e is its end from a zero state. So every chunk is run once from zero,
one small row per chunk is chained over the key, and a second pass fills in the rows from the right entry: three shuffles, whatever
the number of chunks and however slowly the filter forgets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import filters as K
from ..runtime import laid
from .folds import pieces


def transition(sos: np.ndarray) -> np.ndarray:
    """The matrix that one row of zeros applies to the state (two numbers a section)."""
    size = 2 * len(sos)
    _, after = K.apply(sos, np.zeros((1, size)), np.eye(size).reshape(len(sos), 2, size))
    return after.reshape(size, size)


def filtered(df: DataFrame, keys, order: str, chunk: str, columns, sos: np.ndarray, others=(), suffix: str = "") -> DataFrame:
    """`keys`, `order`, `others` as they are and the filtered `columns` (named with `suffix`): `sos` run over each key in `order` from a zero state. `chunk` follows `order`."""
    keys, columns, others = list(keys), list(columns), list(others)
    where = [*keys, chunk]
    kinds = {c: df.schema[c].dataType.simpleString() for c in [*where, order, *others]}
    at = ", ".join(f"`{c}` {kinds[c]}" for c in where)
    shape = (len(sos), 2, len(columns))

    def ends(parts):
        now = None  # key, rows, state
        for pdf, found in pieces(parts, where):
            x, made = pdf[columns].to_numpy(dtype=float), []
            for key, rows in found:
                if now is None or now[0] != key:
                    if now:
                        made.append((*now[0], now[1], now[2].ravel()))
                    now = [key, 0, np.zeros(shape)]
                _, now[2] = K.apply(sos, x[rows], now[2])
                now[1] += rows.stop - rows.start
            yield pd.DataFrame(made, columns=[*where, "__rows", "__end"])
        if now:
            yield pd.DataFrame([(*now[0], now[1], now[2].ravel())], columns=[*where, "__rows", "__end"])

    step = transition(sos)

    def chain(parts):
        at, state = None, None
        for pdf in parts:
            entry = []
            for key, rows, end in zip(zip(*[pdf[c].tolist() for c in keys]), pdf["__rows"].tolist(), pdf["__end"], strict=True):
                if key != at:
                    at, state = key, np.zeros((len(step), len(columns)))
                entry.append(state.ravel())
                state = np.linalg.matrix_power(step, int(rows)) @ state + np.asarray(end).reshape(state.shape)
            yield pdf[where].assign(__entry=entry)

    def fill(parts):
        now = None
        for pdf, found in pieces(parts, where):
            x, out = pdf[columns].to_numpy(dtype=float), np.empty((len(pdf), len(columns)))
            for key, rows in found:
                state = now[1] if now and now[0] == key else np.array(pdf["__entry"].iat[rows.start], dtype=float).reshape(shape)
                out[rows], state = K.apply(sos, x[rows], state)
                now = key, state
            yield pdf[[*keys, order, *others]].assign(**{f"{c}{suffix}": out[:, i] for i, c in enumerate(columns)})

    rows = laid(df.select(*where, order, *columns), where, [order]).mapInPandas(ends, f"{at}, __rows bigint, __end array<double>")
    entries = laid(rows, keys, [chunk]).mapInPandas(chain, f"{at}, __entry array<double>")  # one row per chunk
    out = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*keys, order, *others]], *[f"`{c}{suffix}` double" for c in columns]])
    return laid(df.select(*where, order, *dict.fromkeys([*columns, *others])).join(entries, where), where, [order]).mapInPandas(fill, out)
