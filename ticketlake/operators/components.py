"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.session import cut_lineage


def components(links: DataFrame, a: str, b: str, max_rounds: int = 100,
               keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """(node, root): every node of a link and the smallest node it reaches.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each
    round is a grouped minimum and a join over at most as many rows as there
    are links, so no component is ever gathered in one task or on the driver.
    `keep` materialises a round's table where it survives lost executors.
    Stops when a round changes nothing; raises if `max_rounds` do not suffice.
    """
    def state(t: DataFrame):
        return t.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()

    e = keep(links.select(F.col(a).alias("u"), F.col(b).alias("v"))
                  .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
                  .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = state(e)
    for _ in range(max_rounds):
        # large-star: every neighbour above a node is linked to the node's least neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: a node and its lower neighbours are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u")
                      .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                                F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
                      .select("x.*").where("u <> v").distinct())
        e = keep(small)
        now = state(e)
        if now == was:
            return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
                     .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
        was = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
