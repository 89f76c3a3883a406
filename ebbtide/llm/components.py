"""Connected components of a graph given as a table of links.

Large-star and small-star steps (Kiveris et al., 2014) alternate until nothing changes.
Every step is two aggregations with map-side combine and two equi-joins, which Spark can
split where a node has very many links; each round is written out.
"""

from __future__ import annotations

from ebbtide.llm.scratch import drop, stored
from pyspark.sql import DataFrame, functions as F


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(
        F.count(F.lit(1)), F.expr("bit_xor(xxhash64(hi, lo))")).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (both.join(least, "u").where("v > u")
            .select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"),
                                                           F.col("m").alias("lo"))
    return moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that has a link to another; root is the smallest node.

    ``links`` has two columns of one type, in any order, repeats and loops allowed.
    """
    a, b = (F.col(c) for c in links.columns)
    now = stored(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
                 .where("hi > lo").distinct(), "links")
    state = _state(now)
    while state[0]:
        then = stored(_small_star(_large_star(now)), "links")
        drop(now)
        now, before, state = then, state, _state(then)
        if state == before:
            break
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
