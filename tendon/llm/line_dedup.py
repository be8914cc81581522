"""Incremental line dedup: sharded cuckoo filters over exact reference counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, scratch_path, with_groups, without
from .cuckoo import Cuckoo

_GAPS = b" \t\n\x0b\x0c\r"
#: Keys that one shard of the filter is meant for.
SHARD_KEYS = 200_000
KEY = ["k1", "k2"]
OUT = ("kept_text", "n_lines", "n_dropped")


def _key(line: bytes, least: int) -> bytes | None:
    """128-bit hash of a line's key; None if the key has fewer than `least` code points."""
    import xxhash
    key = line.strip(_GAPS).lower()
    if len(key) < least or len(key) < 4 * least and not key.isascii() and len(key.decode()) < least:
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(doc_id, k1, k2, n): the keys of each row's lines and how often it has them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, keys, n = [], [], []
            for i, text in enumerate(b.column(1).cast(pa.binary())):
                seen: dict[bytes, int] = {}
                for line in (text.as_py() or b"").split(b"\n"):
                    k = _key(line, least)
                    if k:
                        seen[k] = seen.get(k, 0) + 1
                row += [i] * len(seen)
                keys += seen.keys()
                n += seen.values()
            pairs = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()),
                                              pa.array(n, pa.int64())], names=["doc_id", "k1", "k2", "n"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, n long")


@dataclass
class Load:
    """What one insertion wrote: its counts, those of its keys that the store held before (None: none), and its filters in 2^bits shards."""

    counts: str
    held: str | None
    filters: str
    bits: int


class LineStore:
    """Lines of a growing corpus, from which documents can be deleted again.

    Tables in the shared folder, each a list of written segments:

    * references: signed rows (k1, k2, doc_id, n). A deletion writes the negative of what it takes back.
    * counts: signed rows (k1, k2, docs, lines), additive per key: the exact reference counts.
    * suspects: keys that at some time were in two documents.
    * filters: for every insertion cuckoo filters of the keys that were new in it, one per shard of these keys, made to their number.

    An insertion counts its own keys, asks the filters of all insertions before which of them the store may hold already, and looks only those up in
    the exact counts. Keys that are new, or only seemed known, get filters of their own, so a filter is never full and never made anew, and the number of shards
    follows the size of each insertion. A deletion takes keys whose count falls to zero out of the filter of the insertion in which they were last new.
    So line dedup after any insertions and deletions is that of the documents then held.
    Rows of a hot line are spread by document first and counted map-side, so it is one row per task at the shuffle by key.
    """

    def __init__(self, spark: SparkSession, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", least: int = 10, path: str | None = None):
        self.spark, self.shards, self.id_col, self.text_col, self.least = spark, shards, id_col, text_col, least
        self.path = path or scratch_path(spark, "lines")
        self.references: list[str] = []
        self.counts: list[str] = []
        self.suspects: list[str] = []
        self.loads: list[Load] = []
        self.deleted = False
        self._step = 0

    def _write(self, df: DataFrame, kind: str) -> str:
        self._step += 1
        path = f"{self.path}/{kind}-{self._step}"
        df.write.parquet(path)
        return path

    def _read(self, paths: list[str] | str) -> DataFrame:
        return self.spark.read.parquet(*([paths] if isinstance(paths, str) else paths))

    def _few(self, path: str) -> DataFrame:
        """A written table, for a broadcast if its counted rows are few enough."""
        df = self._read(path)
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    def insert(self, docs: DataFrame) -> None:
        """Add documents. Rows with the same id are one document; an id that is held already must be deleted first. Rows without an id are left alone."""
        new = line_keys(docs.where(F.col(self.id_col).isNotNull()), self.id_col, self.text_col, self.least)
        new = self._write(new.groupBy(*KEY, "doc_id").agg(F.sum("n").alias("n")), "references")
        counted = self._write(self._read(new).groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("lines")), "counts")
        keys = self._read(counted)
        bits = max(self.shards - 1, keys.count() // SHARD_KEYS).bit_length()
        suspects, fresh, held = keys.where("docs > 1").select(*KEY), keys.select(*KEY), None
        if self.loads:
            maybe = self._few(self._write(self.maybe(keys, bits), "maybe"))
            known = self._read(self.counts).join(maybe, KEY, "left_semi").groupBy(*KEY).agg(F.sum("docs").alias("docs")).where("docs > 0").select(*KEY)
            held = self._write(known, "held")
            suspects = suspects.union(self._read(held)).distinct()
            fresh = fresh.join(self._few(held), KEY, "left_anti")
        filters = self._write(_shard(fresh, bits).groupBy("shard").applyInPandas(_build, "shard long, data binary"), "filters")
        self.references.append(new)
        self.counts.append(counted)
        self.suspects.append(self._write(suspects, "suspects"))
        self.loads.append(Load(counted, held, filters, bits))

    def maybe(self, keys: DataFrame, bits: int = 0) -> DataFrame:
        """Those of `keys` (k1, k2) that some filter may hold: all that are held, and few others.

        Insertions with equal shards are asked together. Where `keys` need finer shards than a filter has, the filter goes to all its finer shards.
        """
        found = None
        for own in sorted({x.bits for x in self.loads}):
            fine = max(own, bits)
            old = self._read([x.filters for x in self.loads if x.bits == own])
            old = old.selectExpr(f"explode(transform(sequence(0, {(1 << fine - own) - 1}), i -> shard + i * {1 << own}L)) AS shard", "data")
            part = _shard(keys.select(*KEY), fine).groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(_probe, "k1 long, k2 long")
            found = part if found is None else found.union(part)
        return found.distinct()

    def delete(self, ids: DataFrame) -> None:
        """Take back the documents whose ids stand in the first column of `ids`; ids that are not held are passed over."""
        ids = ids.select(F.col(ids.columns[0]).alias("doc_id")).distinct()
        gone = self._write(self.live().join(ids, "doc_id", "left_semi").select(*KEY, "doc_id", (-F.col("n")).alias("n")), "references")
        counted = self._write(self._read(gone).groupBy(*KEY).agg((-F.count(F.lit(1))).alias("docs"), F.sum("n").alias("lines")), "counts")
        self.references.append(gone)
        self.counts.append(counted)
        self.deleted = True
        left = self._read(self.counts).join(self._read(counted).select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.sum("docs").alias("docs"))
        zero = self._few(self._write(left.where("docs = 0").select(*KEY), "zero"))
        new_in = None  # the last insertion in which a key was new
        for i, load in enumerate(self.loads):
            rows = self._read(load.counts).select(*KEY).join(zero, KEY, "left_semi")
            rows = (rows.join(self._read(load.held), KEY, "left_anti") if load.held else rows).withColumn("load", F.lit(i))
            new_in = rows if new_in is None else new_in.union(rows)
        if new_in is None:
            return
        out = self._read(self._write(new_in.groupBy(*KEY).agg(F.max("load").alias("load")), "out"))
        for r in out.groupBy("load").count().collect():  # one row per insertion
            load = self.loads[r.load]
            changed = _shard(out.where(F.col("load") == r.load), load.bits).groupBy("shard").cogroup(self._read(load.filters).groupBy("shard")).applyInPandas(_remove, "shard long, data binary")
            load.filters = self._write(changed, "filters")

    def live(self) -> DataFrame:
        """(k1, k2, doc_id, n) of the documents now held."""
        all_ = self._read(self.references)
        return all_.groupBy(*KEY, "doc_id").agg(F.sum("n").alias("n")).where("n > 0") if self.deleted else all_.select(*KEY, "doc_id", "n")

    def drops(self) -> DataFrame:
        """(doc_id, keys): for each document the keys whose lines it loses to one with a smaller id.

        Suspects whose exact count is over one are shared; only references to these are kept, and only they are searched for the smallest id.
        """
        suspects = self._few(self._write(self._read(self.suspects).distinct(), "suspects"))
        shared = self._read(self.counts).join(suspects, KEY, "left_semi").groupBy(*KEY).agg(F.sum("docs").alias("docs")).where("docs > 1")
        shared = self._read(self._write(shared, "shared"))
        rows = self.live().select(*KEY, "doc_id")
        total = rows.count()
        small = shared.count() <= BROADCAST_ROWS
        met = rows.join(F.broadcast(shared), KEY) if small else with_groups(rows, shared, KEY, ["docs"], "docs", total, "doc_id").where("docs IS NOT NULL")
        met = self._read(self._write(met.select(*KEY, "doc_id", "docs"), "met"))
        first = met.groupBy(*KEY).agg(F.min("doc_id").alias("first"), F.max("docs").alias("docs"))
        first = self._read(self._write(first, "first"))
        rows = met.select(*KEY, "doc_id")
        told = rows.join(F.broadcast(first), KEY) if small else with_groups(rows, first, KEY, ["first"], "docs", total, "doc_id")
        return told.where("doc_id > first").groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("keys"))  # at most the lines of one document

    def dedup(self, docs: DataFrame) -> DataFrame:
        """`docs` (documents of the store) with kept_text, n_lines and n_dropped.

        A text is split at every line feed; null or empty is one empty line. Lines are equal when their keys are: ASCII white space
        taken off both ends, A-Z lower-cased. Keys of at least `least` code points that two documents hold lose all their lines
        but in the smallest id holding them. Rows without an id, and rows whose id the store does not hold, keep all lines; rows that repeat an id are one document, and each
        gives its row. An empty table gives no rows. Input columns called like a result give way to it.
        """
        names = without(docs, *OUT)
        least, at = self.least, len(names)
        joined = (docs.withColumn("__t", F.col(self.text_col).cast("string")).withColumn("__id", F.col(self.id_col))
                  .join(self.drops().withColumnsRenamed({"doc_id": "__doc", "keys": "__keys"}), F.col("__id") == F.col("__doc"), "left")
                  .select(*names, "__t", "__keys"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                kept, lines, dropped = [], [], []
                for text, keys in zip(b.column(at).cast(pa.binary()), b.column(at + 1), strict=True):
                    parts = (text.as_py() or b"").split(b"\n")
                    gone = keys.as_py()
                    rest = parts
                    if gone:
                        out = {np.array([k["k1"], k["k2"]], np.int64).tobytes() for k in gone}
                        rest = [x for x in parts if _key(x, least) not in out]
                    kept.append(b"\n".join(rest))
                    lines.append(len(parts))
                    dropped.append(len(parts) - len(rest))
                yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                                                 names=[*b.schema.names[:at], *OUT])

        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:at]]
        return joined.mapInArrow(run, ", ".join([*fields, "kept_text string", "n_lines long", "n_dropped long"]))


def _shard(keys: DataFrame, bits: int) -> DataFrame:
    return keys.select(F.pmod("k1", F.lit(1 << bits)).alias("shard"), *KEY)


def _probe(keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    hit = np.zeros(len(keys), bool)
    for data in old["data"]:
        hit |= Cuckoo.load(data).might_hold(keys["k2"].to_numpy())
    return keys.loc[hit, ["k1", "k2"]]


def _remove(key: tuple, keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    made = []
    for data in old["data"]:
        filter_ = Cuckoo.load(data)
        filter_.remove(keys["k2"].to_numpy())
        made.append(filter_.dump())
    return pd.DataFrame({"shard": [key[0]] * len(made), "data": made})


def _build(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [key[0]], "data": [Cuckoo.of(keys["k2"].to_numpy()).dump()]})


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, loads: int = 2) -> DataFrame:
    """`LineStore.dedup` of a table that is inserted in `loads` parts, as a growing corpus is."""
    store = LineStore(docs.sparkSession, id_col=id_col, text_col=text_col, least=least)
    for i in range(loads):
        store.insert(docs.where(F.pmod(F.xxhash64(id_col), F.lit(loads)) == i))
    return store.dedup(docs)
