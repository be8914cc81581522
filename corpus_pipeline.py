"""From raw documents to packed training windows, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written as Parquet and read back.
All but the last return the columns of `documents`. A stage starts by removing the scratch tables of the one before, whose result is written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendon.llm.common import remove, saved, stage
from tendon.llm.language_id import NONE, fit, predict
from tendon.llm.line_dedup import dedup_lines
from tendon.llm.mixing import mix
from tendon.llm.near_copies import keep_one
from tendon.llm.packing import pack
from tendon.llm.queries import domain_of, mixture
from tendon.runtime import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle in the near-duplicate stage, and the Jaccard index, in hundredths, from which two documents are linked.
SHINGLE = 5
ALIKE = 80
#: Bits in which fingerprints may differ for op 5 to link them.
BITS = 2
#: Share of the tokens at hand that the mixture asks for; each document is taken once at most.
SHARE = 0.9


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows. A text that is null or has no letter goes; a missing label is filled in. Where no label can be learned from, all others stay."""
    net = fit(docs)
    if net is None:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    found = predict(docs.select(*COLUMNS), net).where(F.col("lang_pred") != NONE)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that one with a smaller id holds. A document may end up empty; it stays."""
    done = dedup_lines(docs.select(*COLUMNS))
    return done.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by shingle sets that are alike.

    Op 5's fingerprints and index of byte positions give the first candidates, min-wise bands those that differ in more than BITS bits; exact sets verify all.
    """
    return keep_one(docs.select(*COLUMNS), width=SHINGLE, percent=ALIKE, bits=BITS)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen by the weights of domains and languages, each at most once."""
    wanted = F.floor(F.col("tokens") * SHARE)
    return mix(docs.select(*COLUMNS), mixture(spark), domain_of(), total=wanted, epochs=1).select(*COLUMNS)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1,024 tokens."""
    return pack(docs.select("doc_id", "text"))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("mix", mixed), ("pack", packed)]
#: Neither the network, the fingerprints nor the packing can be said in SQL; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result but the last is written to the shared folder and read back, and the one before it removed."""
    ship(spark)
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        docs = saved(step(spark, docs, sf_dir), name)
        if old:
            remove(spark, old)
        old = docs.scratch
    return STAGES[-1][1](spark, docs, sf_dir)
