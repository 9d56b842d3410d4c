"""Connected components of a link table, labelled by the smallest node.

Alternating large-star and small-star rounds: each round hangs every node's larger neighbours, then all its neighbours, on
the smallest node it knows, so the forest flattens to stars in a number of rounds that grows with the logarithm of the
longest chain. Every step is a grouped minimum (combined before the shuffle) and an equi join on the node (which adaptive
execution splits where one node is hot); rounds are cut as tables in the shared scratch folder. Links never reach the
driver: only a count and a checksum do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut, discard


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): every node that has a link to another node, with the smallest node it is connected to.

    links: rows of two nodes of one orderable type. Null ends and links of a node to itself are left out; an empty table
    gives no rows; repeated links change nothing."""
    now = cut(links.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    state = None
    while True:
        large = _large_star(now)
        after = cut(_small_star(large))
        discard(now)
        seen = after.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")).first()
        now = after
        if (seen.n, seen.h) == state or seen.n == 0:
            break
        state = (seen.n, seen.h)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
