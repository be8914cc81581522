"""Packing token pieces into fixed windows by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .tokens import encode_array, vocabulary_path

#: Rows of one length that are ordered in one group.
RANK_ROWS = 20_000


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str, end_id: int, with_ids: bool) -> DataFrame:
    """Each document's ids with `end_id` behind them, cut at every `capacity` ids: all but the last piece are full."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in enumerate(b.column(1)):
                ids = np.append(encode_array(text.as_py(), path), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at:at + capacity]
                    rows.append((i, at, len(part), zlib.crc32(part.tobytes()), len(ids), part if with_ids else None))
            index, start, length, crc, total, parts = zip(*rows, strict=True) if rows else [()] * 6
            columns = [b.column(0).take(pa.array(index, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["__id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("t"))
    kind = source.schema["__id"].dataType.simpleString()
    return source.mapInArrow(run, f"__id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def _fill(left: dict[int, int], first: int, capacity: int) -> dict[int, int]:
    """Lengths to put beside `first`, from those `left`, so that the window has least slack.

    Bit s of `reach` says whether a multiset sums to s; a length with many pieces enters in powers of two.
    The state before each step is kept, and walking back over the steps gives the counts. A window whose
    sum is a power of two has no slack, as such windows are not padded.
    """
    room = capacity - first
    mask = (2 << room) - 1
    exact = [1 << k for k in range(capacity.bit_length()) if first <= 1 << k <= capacity] + [capacity]
    reach, steps = 1, []
    for length, n in sorted(left.items(), key=lambda x: -x[1]):
        n = min(n, room // length)
        size = 1
        while n > 0:
            take = min(size, n)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            n -= take
            size *= 2
        if reach >> room & 1:
            break
    done = [s for s in exact if reach >> (s - first) & 1]
    total = max(done) - first if done else reach.bit_length() - 1
    counts: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            counts[length] = counts.get(length, 0) + take
            total -= length * take
    return counts


def plan(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """Runs (length, first, base, each, offset): pieces of a length with rank `first` and up go, `each` to a window, into
    windows from `base` on, at `offset`.

    Each window starts with the longest piece left and is filled by `_fill`; the same filling is used as often as the
    counts allow. Only the counts of the `capacity` possible lengths enter, however many pieces there are.
    """
    left = {k: n for k, n in histogram.items() if n}
    used = dict.fromkeys(left, 0)
    base, runs = 0, []
    while left:
        first = max(left)
        rest = {k: n - (k == first) for k, n in left.items() if k <= capacity - first and n - (k == first) > 0}
        counts = _fill(rest, first, capacity)
        counts[first] = counts.get(first, 0) + 1
        times = min(left[k] // n for k, n in counts.items())
        offset = 0
        for k, n in sorted(counts.items(), reverse=True):
            runs.append((k, used[k], base, n, offset))
            used[k] += n * times
            left[k] -= n * times
            if not left[k]:
                del left[k]
            offset += k * n
        base += times
    return pd.DataFrame(runs, columns=["length", "first", "base", "each", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, path: str | None = None,
         end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id and offset, with `ids` on request.

    Windows hold at most `capacity` ids, and their pieces stand without gaps from 0. A document longer than a window is cut at
    multiples of `capacity`; what remains of it, and every shorter document, is placed by minimum bin slack over the counts of all
    lengths in the table. Pieces of one length are ranked in groups of about RANK_ROWS, so no length is ordered in one task.

    A null or empty text is the end id alone. An empty table gives no rows; rows that repeat an id are packed each for itself.
    Other columns are not looked at.
    """
    cut = saved(pieces(docs, id_col, text_col, capacity, path or vocabulary_path(), end_id, with_ids), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = plan(histogram, capacity)
    spread = max(1, sum(histogram.values()) // RANK_ROWS)
    dealt = cut.withColumn("__group", F.pmod(F.xxhash64("__id", "start", "ids_crc32"), F.lit(spread)))
    before = (dealt.groupBy("length", "__group").count()
              .selectExpr("length", "__group", "sum(count) OVER (PARTITION BY length ORDER BY __group) - count AS __before"))
    ranked = (dealt.join(before, ["length", "__group"])
              .selectExpr("*", "__before + row_number() OVER (PARTITION BY length, __group ORDER BY __id, start, ids_crc32) - 1 AS __rank"))
    keys = (runs["length"].to_numpy(np.int64) << 44) + runs["first"].to_numpy(np.int64)
    first, base, each, offset = (runs[c].to_numpy(np.int64) for c in ("first", "base", "each", "offset"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "__rank"))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            window, slot = np.divmod(rank - first[at], each[at])
            kept = b.drop_columns(["__rank"])
            yield kept.append_column("sequence_id", pa.array(base[at] + window)).append_column("offset", pa.array(offset[at] + slot * length))

    shown = ranked.select(*cut.columns, "__rank")
    return shown.mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long") \
        .withColumnRenamed("__id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """The windows themselves, from pieces packed with their ids: sequence_id, input_ids, and the ids and starts of their documents."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("input_ids"), F.col("p.offset").alias("starts"))
