"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialise


def _stamp(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return row["n"], int(row["s"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u, v): root is the least node that can be reached.

    Self-links and repeated links are allowed. Every step is written to the
    shared folder before it is joined, so a hub's rows come straight from
    an exchange that adaptive execution may split; sums and minima are
    formed before each exchange. Rounds grow with the logarithm of the
    longest chain.
    """
    edges = materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _stamp(edges)
    while before[0]:
        # large star: larger neighbours of a node move to the least node around it
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
        large = materialise(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: smaller neighbours of a node, and the node, move to the least of them
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialise(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _stamp(edges)
        if after == before:
            break
        before = after
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
