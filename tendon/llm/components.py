"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, saved


def _large_star(links: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest node around it."""
    both = links.select("u", "v").union(links.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in `links` (u, v); label is the smallest node it can reach.

    Alternating star contractions: about log(n) rounds, each a few shuffles of the links, whose number never grows.
    Minima are taken map-side, and the joins on a hub are split by adaptive execution. Each round is written to
    the shared folder, and the round before it removed.
    """
    links = saved(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        old, links = links, saved(_small_star(_large_star(links)).where("u <> v").distinct(), "links")
        remove(links.sparkSession, old.scratch)
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
