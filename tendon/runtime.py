"""Session settings that the operators need."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: `spark.checkpoint.dir`.

    A temporary folder is used only where the session names none (local tests).
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        current = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder, so later passes and lost executors reread it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def laid(df: DataFrame, keys, order) -> DataFrame:
    """Rows of equal `keys` in one partition, sorted by keys and order, for a Python function over partitions.

    A function over partitions asks nothing of its input. Spark may therefore drop `repartition(*keys)` behind a join on the same keys and, once that becomes a broadcast join,
    read the rows where they were made, so that a key lies in several tasks. A hash of the keys is no partitioning that a join or grouping has, so this one stays.
    """
    keys = list(keys)
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


_SHIPPED: set[int] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package (their Python functions import it)."""
    sc = spark.sparkContext
    if id(sc._jsc) in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "tendon.zip")  # read by the driver only, which serves it
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "tendon")):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, root))
    sc.addPyFile(name)
    _SHIPPED.add(id(sc._jsc))
