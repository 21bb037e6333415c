"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemeta.llm.common import saved

#: Rows of 16 bytes for a task to write. Rounds over few links are few tasks and files, however many shuffle partitions there are.
_ROWS = 1 << 18


def components(links: DataFrame) -> DataFrame:
    """(node, root): every linked node with the smallest node it can reach; ``links`` is (u, v).

    Each round points nodes at the smallest neighbour of a neighbour. Nothing is gathered per node:
    smallest neighbours are found with a map-side combined minimum, written, and joined back, where a
    hot node's links can be split among tasks. Rounds grow with the logarithm of the largest component.
    """
    stars = saved(_ordered(links.select("u", "v")), "stars")
    before = None
    while (now := _digest(stars)) != before:
        before, tasks = now, 1 + now[0] // _ROWS
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = saved(both.groupBy("u").agg(F.min("v").alias("low"))
                       .withColumn("low", F.least("u", "low")).coalesce(tasks), "lowest")
        large = saved(_ordered(both.join(lowest, "u").filter("v > u").select(F.col("low").alias("u"), "v")).coalesce(tasks), "large")
        lowest = saved(large.groupBy("v").agg(F.min("u").alias("low")).coalesce(tasks), "lowest")
        small = large.join(lowest, "v").select(F.col("low").alias("u"), F.col("u").alias("v"))
        stars = saved(_ordered(small.unionByName(lowest.select(F.col("low").alias("u"), "v"))).coalesce(tasks), "stars")
    roots = stars.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(stars.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _ordered(links: DataFrame) -> DataFrame:
    return links.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _digest(links: DataFrame):
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
