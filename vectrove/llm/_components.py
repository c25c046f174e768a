"""Connected components of a table of links, by alternating large-star and
small-star steps (Kiveris et al., SoCC 2014).

A step joins links with the smallest neighbour of each node, found by an
aggregation with partial sums.  Up to a counted number of links that table is
broadcast; beyond it nodes with a large share of all links, of which there can
be few, are joined apart from the others.  Each step's links are written to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrove.llm._common import materialize, release
from vectrove.llm._exchange import split_join

#: Links up to which the table of smallest neighbours (24 bytes a node, two nodes a link at most) is broadcast.
BROADCAST_LINKS = 1 << 18


def _nearest(rows: DataFrame, low: DataFrame, links: int) -> DataFrame:
    if links <= BROADCAST_LINKS:
        return rows.join(F.broadcast(low), F.col("u") == F.col("w"))
    return split_join(rows, low, [("u", "w")], "n", 2 * links)


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"), F.count("*").alias("n")).select("w", F.least("w", "m").alias("m"), "n")
    return _nearest(both.where("v > u"), low, links).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, links: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _nearest(down, low, links).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, tag: str) -> DataFrame:
    """node, component (its smallest node) for every node with a link to another.

    ``edges`` has long columns u and v; loops and repeated links do no harm.
    """
    now = materialize(edges.select("u", "v").where("u <> v").distinct(), f"{tag}-links")
    links = now.count()  # steps never add links
    seen = None
    while True:
        after = materialize(_small_star(_large_star(now, links), links), f"{tag}-links")
        release(now)
        now = after
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == seen:
            break
        seen = tuple(found)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
