"""Order-dependent state machines, split into chunks and still exact.

`run(state, rows) -> (state, output rows)` folds one ordered chunk; the state
is a small JSON value. Every chunk of a key is first folded from the start
state. Then each chunk is checked: if it did not begin with the state in which
its predecessor ends, it is folded again from that state. The loop stops when
all chunks agree; by induction from the first chunk the result equals one pass
over the key. Machines of this kind forget their start quickly, so two rounds
are usual, and each later round reads only the chunks that still differ.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut, laid


class RowFold:
    """`step(state, row) -> (state, [output tuple, ...])` as a chunk function; also folds a sorted partition row by row."""

    def __init__(self, step: Callable, names):
        self.step, self.names = step, list(names)

    def __call__(self, state, pdf):
        made = []
        for row in records(pdf):
            state, out = self.step(state, row)
            made.extend(out)
        return state, pd.DataFrame(made, columns=self.names)


def by_row(step: Callable, names) -> RowFold:
    return RowFold(step, names)


def records(pdf: pd.DataFrame):
    """The rows as dicts of Python values."""
    names = list(pdf.columns)
    return (dict(zip(names, row)) for row in zip(*[pdf[c].tolist() for c in names]))


def pieces(parts, where):
    """(frame, (key, rows of one chunk in this frame)), in order."""
    for pdf in parts:
        at = np.flatnonzero((pdf[where] != pdf[where].shift()).any(axis=1).to_numpy())
        keys = zip(*[pdf[c].iloc[at].tolist() for c in where])
        yield pdf, [(key, slice(lo, hi)) for key, lo, hi in zip(keys, at, [*at[1:], len(pdf)])]


def _clean(rows, columns) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.astype(object).where(out.notna(), None)


def grouped_rows(df: DataFrame, where, order, fn: Callable, names, schema: str) -> DataFrame:
    """fn(list of row dicts) -> output tuples for each small group of a sorted partition.

    Thousands of short groups share an Arrow batch; only one group is held at a time.
    """
    where = list(where)

    def run(parts):
        held, at = [], None
        for pdf in parts:
            made = []
            for row in records(pdf):
                key = tuple(row[c] for c in where)
                if key != at and held:
                    made.extend(fn(held))
                    held = []
                at = key
                held.append(row)
            yield _clean(made, names)
        if held:
            yield _clean(fn(held), names)

    return laid(df, where, order).mapInPandas(run, schema)


def chunked_fold(df: DataFrame, keys, order, chunk: str, run: Callable, start, schema: str) -> DataFrame:
    """Outputs of `run` over each key in `order`; `schema` lists the output columns without the keys."""
    keys, order = list(keys), list(order)
    where = keys + [chunk]
    kinds = {c: df.schema[c].dataType.simpleString() for c in where}
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    blank = json.dumps(start)
    end_schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", entry string, exit string"
    out_schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", " + schema
    pick = None

    if isinstance(run, RowFold):
        step = run.step
        pick = [run.names.index(n) for n in names]

        def ends_of(parts):
            at, entry, state = None, None, None
            for pdf in parts:
                made = []
                for row in records(pdf):
                    key = tuple(row[c] for c in where)
                    if key != at:
                        if at is not None:
                            made.append((*at, entry, json.dumps(state)))
                        at, entry = key, row["__entry"]
                        state = json.loads(entry)
                    state, _ = step(state, row)
                yield pd.DataFrame(made, columns=[*where, "entry", "exit"])
            if at is not None:
                yield pd.DataFrame([(*at, entry, json.dumps(state))], columns=[*where, "entry", "exit"])

        def rows_of(parts):
            at, state = None, None
            for pdf in parts:
                made = []
                for row in records(pdf):
                    key = tuple(row[c] for c in where)
                    if key != at:
                        at, state = key, json.loads(row["__entry"])
                    state, out = step(state, row)
                    made.extend((*key[:-1], *(o[i] for i in pick)) for o in out)
                yield _clean(made, [*keys, *names])

        ends = lambda d: laid(d, where, order).mapInPandas(ends_of, end_schema)
        emit = lambda d: laid(d, where, order).mapInPandas(rows_of, out_schema)
    else:
        def fold(pdf: pd.DataFrame):
            return run(json.loads(pdf["__entry"].iloc[0]), pdf.sort_values(order, kind="stable"))

        def chunk_ends(pdf: pd.DataFrame) -> pd.DataFrame:
            state, _ = fold(pdf)
            return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in where}, "entry": [pdf["__entry"].iloc[0]], "exit": [json.dumps(state)]})

        def chunk_rows(pdf: pd.DataFrame) -> pd.DataFrame:
            _, made = fold(pdf)
            out = made[names].astype(object).where(made[names].notna(), None)
            for i, c in enumerate(keys):
                out.insert(i, c, pdf[c].iloc[0])
            return out

        ends = lambda d: d.groupBy(*where).applyInPandas(chunk_ends, end_schema)
        emit = lambda d: d.groupBy(*where).applyInPandas(chunk_rows, out_schema)

    by_key = Window.partitionBy(*keys).orderBy(chunk)  # one row per chunk
    rows = cut(df)
    several = rows.groupBy(*keys).agg(F.min(chunk).alias("a"), F.max(chunk).alias("b")).where("a < b")
    if not several.take(1):
        return emit(rows.withColumn("__entry", F.lit(blank)))
    known = cut(ends(rows.withColumn("__entry", F.lit(blank))))
    while True:
        want = known.withColumn("__want", F.coalesce(F.lag("exit").over(by_key), F.lit(blank)))
        stale = cut(want.where("__want <> entry").select(*where, F.col("__want").alias("__entry")))
        if not stale.take(1):
            break
        known = cut(known.join(stale, where, "left_anti").unionByName(ends(rows.join(stale, where))))
    return emit(rows.join(known.select(*where, F.col("entry").alias("__entry")), where))


def blended(df: DataFrame, keys, order: str, chunk: str, columns, weight: float) -> DataFrame:
    """`df` with `<column>_mean`: (1 - weight) x the mean before + weight x the row, from the first row of a key on.

    The recurrence is linear, so a chunk maps its entry y to (1 - weight)^rows x y + its own end from zero. One pass takes these ends, one row per
    chunk is chained over the key, and a second pass fills in the rows: three shuffles whatever the number of chunks.
    """
    keys, columns = list(keys), list(columns)
    where = keys + [chunk]
    keep = 1.0 - weight
    kinds = {c: df.schema[c].dataType.simpleString() for c in df.columns}
    zero = np.zeros(len(columns))
    numbers = ", ".join(f"`__{kind}{i}` double" for kind in ("first", "end") for i in range(len(columns)))

    def run(y, x):
        out = np.empty_like(x)
        for i, row in enumerate(x):
            y = keep * y + weight * row
            out[i] = y
        return out

    def ends(parts):
        now = None
        for pdf, found in pieces(parts, where):
            made, x = [], pdf[columns].to_numpy(dtype=float)
            for key, rows in found:
                if now is None or now[0] != key:
                    if now:
                        made.append((*now[0], now[1], *now[2], *now[3]))
                    now = [key, 0, x[rows.start], zero]
                out = run(now[3], x[rows])
                now[1], now[3] = now[1] + len(out), out[-1]
            yield pd.DataFrame(made, columns=names)
        if now:
            yield pd.DataFrame([(*now[0], now[1], *now[2], *now[3])], columns=names)

    def chain(parts):
        """The entry of every chunk; a sorted partition holds many keys, most of one chunk."""
        at, y = None, None
        for pdf in parts:
            first, end = (pdf[[f"__{k}{i}" for i in range(len(columns))]].to_numpy(dtype=float) for k in ("first", "end"))
            entry = []
            for i, (key, n) in enumerate(zip(zip(*[pdf[c].tolist() for c in keys]), pdf["__rows"].tolist())):
                if key != at:
                    at, y = key, first[i]
                entry.append(y.tolist())
                y = keep ** n * y + end[i]
            yield pdf[where].assign(__entry=entry)

    def fill(parts):
        now = None
        for pdf, found in pieces(parts, where):
            x, entry = pdf[columns].to_numpy(dtype=float), pdf["__entry"].to_numpy()
            out = np.empty_like(x)
            for key, rows in found:
                y = now[1] if now and now[0] == key else np.array(entry[rows.start])
                out[rows] = run(y, x[rows])
                now = key, out[rows.stop - 1]
            yield pdf.drop(columns="__entry").assign(**{f"{c}_mean": out[:, i] for i, c in enumerate(columns)})

    names = [*where, "__rows", *[f"__{k}{i}" for k in ("first", "end") for i in range(len(columns))]]
    at = ", ".join(f"`{c}` {kinds[c]}" for c in where)
    rows = laid(df.select(*where, order, *columns), where, [order]).mapInPandas(ends, f"{at}, __rows bigint, {numbers}")
    entries = laid(rows, keys, [chunk]).mapInPandas(chain, f"{at}, __entry array<double>")
    out = ", ".join([*[f"`{c}` {kinds[c]}" for c in df.columns], *[f"`{c}_mean` double" for c in columns]])
    return laid(df.join(entries, where).select(*df.columns, "__entry"), where, [order]).mapInPandas(fill, out)
