"""Connected components of a link table, by alternating star contractions.

Every round rewrites the links with grouped minima and joins only. A node that a third of
the links meet is a skewed join side, never a list in one task, and neither nodes nor links
pass through the driver: it sees one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import stored

MAX_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the smallest node it knows."""
    both = links.unionAll(links.select(F.col("low").alias("high"), F.col("high").alias("low")))
    both = both.toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    moved = both.where(F.col("other") > F.col("node")).join(least, "node")
    return moved.select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, move to the smallest of them."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    moved = links.join(least, "high").where(F.col("low") > F.col("least"))
    moved = moved.select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.unionAll(least.toDF("high", "low")).distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node reachable.

    ``links`` has one row per link, in either direction; repeated links, links to oneself
    and null ends are allowed and change nothing. Nodes without a link are not returned.
    """
    pairs = links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
    pairs = pairs.where(links[a].isNotNull() & links[b].isNotNull() & (F.col("high") > F.col("low")))
    current = stored(pairs.distinct(), "links")
    mark = None
    for _ in range(MAX_ROUNDS):
        current = stored(_small_star(_large_star(current)), "stars")
        row = current.agg(
            F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))
        ).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    roots = current.select(F.col("low").alias("node")).distinct()
    return current.toDF("node", "component").unionAll(roots.select("node", F.col("node").alias("component")))
