"""Connected components of links between 64-bit keys, by alternating stars over DataFrames.

Each round, every key's larger neighbours move to its smallest neighbour (large star), then its smaller ones (small star).
A key's neighbours are never collected: minima are aggregated, and joined back to the links, where a key with very many
links can be split. Each round is written, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _towards_least(links: DataFrame) -> DataFrame:
    """links (u, v): each v goes to the least of u and u's partners."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return links.join(least, "u").select("u", "v", "m")


def _signature(links: DataFrame):
    """Count and combined hash of the links: equal for equal sets."""
    return links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links with columns a and b -> (key, root) for each key of a link, root being the least key of its component."""
    now = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    known = _signature(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _towards_least(large)
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "links")
        before, known = known, _signature(now)
        if known == before:
            roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "key")
            return roots.unionByName(now.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components still change after {rounds} rounds")
