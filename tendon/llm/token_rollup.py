"""Token totals by source, language and tokenizer version, maintained from signed changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scratch
from .tokens import ids_of, vocabulary_path

GROUP = ["source", "lang", "tokenizer"]


def token_count(text: Column, path: str | None = None) -> Column:
    """Ids of the whole text; null counts as empty."""
    path = path or vocabulary_path()

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([len(ids_of(t, path)) for t in texts], dtype="int64")

    return count(text)


def inserts(counts: DataFrame) -> DataFrame:
    """Signed changes that add every row of `counts` (source, lang, tokenizer, tokens)."""
    return counts.select(*GROUP, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Signed changes that take every row of `counts` away."""
    return counts.select(*GROUP, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).cast("long").alias("tokens"))


def revisions(pairs: DataFrame) -> DataFrame:
    """Signed changes from the `old` to the `new` state of each row, both structs (source, lang, tokenizer, tokens); a null struct is no row.

    One read of the rows: each gives the negative of its old state and its new state.
    """
    def signed(state: str, sign: int) -> Column:
        return F.when(F.col(state).isNotNull(), F.struct(*[F.col(f"{state}.{g}").alias(g) for g in GROUP], F.lit(sign).cast("long").alias("docs"),
                                                        (F.lit(sign) * F.col(f"{state}.tokens")).cast("long").alias("tokens")))
    return pairs.select(F.explode(F.filter(F.array(signed("old", -1), signed("new", 1)), lambda x: x.isNotNull())).alias("c")).select("c.*")


class TokenRollup:
    """Additive totals in a shared folder, one committed folder per batch.

    A batch is reduced to one signed row per (source, lang, tokenizer), map-side first, so a source with a third of all documents
    is one row per task. The folder's _SUCCESS file, which Spark writes last, commits the batch: a batch that is sent again is left
    alone, and one that broke off is written anew. Totals are sums over committed batches, in any order.
    `compact` folds them into one snapshot that remembers the batches it holds.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch(spark, "rollup")

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _committed(self, kind: str) -> list[str]:
        fs, path = self._fs()
        root = path(f"{self.path}/{kind}")
        if not fs.exists(root):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if fs.exists(path(s.getPath(), "_SUCCESS")))

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """Path of the last snapshot and the batches in it."""
        found = self._committed("totals")
        if not found:
            return None, set()
        return f"{self.path}/totals/{found[-1]}", {r[0] for r in self.spark.read.parquet(f"{self.path}/covered/{found[-1]}").collect()}

    def batches(self) -> set[str]:
        return set(self._committed("batches")) | self._snapshot()[1]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the signed rows of `changes`; False if a batch of this name is committed already. Names are file names."""
        if batch in self.batches():
            return False
        deltas = changes.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        deltas.write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) of the groups that hold documents or tokens; null source and language are groups of their own."""
        snapshot, inside = self._snapshot()
        paths = [f"{self.path}/batches/{b}" for b in self._committed("batches") if b not in inside] + ([snapshot] if snapshot else [])
        if not paths:
            return self.spark.sql("SELECT '' AS source, '' AS lang, '' AS tokenizer, 0L AS docs, 0L AS tokens WHERE false")
        return (self.spark.read.parquet(*paths).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .where("docs <> 0 OR tokens <> 0"))

    def compact(self) -> None:
        """Write the totals as a snapshot, which stands for the batches in it; their folders may then be deleted."""
        names = sorted(self.batches())
        number = f"{len(self._committed('totals')):08d}"
        self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/covered/{number}")
        self.totals().write.mode("overwrite").parquet(f"{self.path}/totals/{number}")  # its _SUCCESS file makes the snapshot valid


def count_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k", path: str | None = None, rollup: TokenRollup | None = None, name: str = "documents") -> DataFrame:
    """Totals of `docs` (text, n_chars, source, lang), kept in `rollup`.

    The first batch inserts each document with the count that its length suggests (a token for four characters), the second revises it to the
    exact count; the first is then sent again, as after a lost answer, and changes nothing. A null or empty text has no
    tokens; a null length suggests none; rows that repeat an id count each. An empty table gives no rows.
    """
    rollup = rollup or TokenRollup(docs.sparkSession)
    state = [F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer")]
    guess = F.coalesce(F.ceil(F.col("n_chars") / 4), F.lit(0)).cast("long")
    rough = inserts(docs.select(*state, guess.alias("tokens")))
    rollup.commit(f"{name}-by-length", rough)
    pairs = docs.select(F.struct(*state, guess.alias("tokens")).alias("old"), F.struct(*state, token_count(F.col("text"), path).alias("tokens")).alias("new"))
    rollup.commit(f"{name}-exact", revisions(pairs))
    rollup.commit(f"{name}-by-length", rough)
    return rollup.totals()
