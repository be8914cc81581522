"""What several of the operators share."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, scratch

#: ASCII white space, as a character class of Java, DuckDB and Python patterns.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: A table of at most this many rows may be broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


#: Scratch tables that this process has written and not removed.
_MADE: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that `sweep` may remove."""
    path = scratch(spark, name)
    _MADE.append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder as Parquet and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables that nothing will read again."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _MADE:
            _MADE.remove(path)


#: Scratch tables that the last stage of a job made; its result may still read them.
_LAST: list[str] = []
#: Rows and bytes of an Arrow batch in a stage. Batches hold whole texts, in Spark's memory outside the heap and in every Python worker at once, and workers keep what they once took.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def stage(fn):
    """A stage (spark, docs, sf_dir) of a job, which first removes the scratch tables made inside the stage before it, as that one's result is written by now. What `docs` reads stays.

    The limits of BATCH are set here and stay, as a stage's result is planned when it is written, and stages may be called one by one.
    """
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, most in BATCH.items():
            spark.conf.set(name, most)
        if _LAST:
            read = {part for f in docs.inputFiles() for part in f.split("/")[-4:]}
            remove(spark, *[p for p in _LAST if p.rstrip("/").rsplit("/", 1)[-1] not in read])
        before = len(_MADE)
        out = fn(spark, docs, sf_dir)
        _LAST[:] = _MADE[before:]
        return out

    return run


def counted(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Make `df` once; broadcast it only if its counted rows are few enough, else leave the join to Spark."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= limit else df


#: A group that holds more than one row in so many is hot; there can be no more hot groups than that.
HOT_SHARE = 1000


def with_groups(rows: DataFrame, groups: DataFrame, key: list[str], values: list[str], size: str, total: int, spread: str) -> DataFrame:
    """`rows` with the `values` of their group, null where there is none. `groups` has one row per `key` and, in `size`, at most `total` rows of `rows` altogether.

    Hot groups are at most HOT_SHARE in number, whatever the table, so they are broadcast; their rows go on under a key of their own, made from
    the column `spread`, and do not meet. All other groups are small and joined by a shuffle.
    """
    hot = (groups.where(F.col(size) > total // HOT_SHARE).select(*[F.col(k).alias(f"__hot_{k}") for k in key], *[F.col(v).alias(f"__hot_{v}") for v in values]))
    cold = groups.where(F.col(size) <= total // HOT_SHARE).select(*[F.col(k).alias(f"__cold_{k}") for k in key], *[F.col(v).alias(f"__cold_{v}") for v in values])
    marked = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"__hot_{k}") for k in key], "left")
    own = F.xxhash64(F.lit(91), spread)
    dealt = marked.withColumns({f"__own_{k}": F.when(F.col(f"__hot_{key[0]}").isNull(), F.col(k)).otherwise(own.cast(rows.schema[k].dataType)) for k in key})
    met = dealt.join(cold, [F.col(f"__own_{k}") == F.col(f"__cold_{k}") for k in key], "left")
    return met.select(*rows.columns, *[F.when(F.col(f"__hot_{key[0]}").isNotNull(), F.col(f"__hot_{v}")).otherwise(F.col(f"__cold_{v}")).alias(v) for v in values])


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of `df` but those called `names` in any case: an input column gives way to a result of the same name."""
    gone = {n.lower() for n in names}
    return [f"`{c}`" for c in df.columns if c.lower() not in gone]
