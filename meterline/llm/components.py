"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a min per node (combined map-side) joined back to the links, so a hub with
a third of all links is an AQE-splittable join key and never one task's list. The link
table is written to the shared folder between rounds, which cuts lineage. No side of a join
goes by way of the driver: a minimum per node is as many rows as there are nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import merged, save


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.where("v > u").join(merged(least), "u")
            .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    # links hold u > v; each node's smaller neighbours and the node itself go to the least of them
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(merged(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """``(node, root)`` for every node that has a link; ``root`` is the least node of its component.

    Null ends and self-links are ignored; repeated links count once; an empty table gives
    an empty result. Raises if the rounds do not settle (never returns a partial result).
    """
    now = (links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
           .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    now = save(now, "links")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        after = save(_small_star(_large_star(now)), "links")
        was, state = state, _state(after)
        now = after
        if state == was:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
