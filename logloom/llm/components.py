"""Connected components of a link table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.tables import checkpointed


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """node, component (its smallest node) for every node of links (a bigint, b bigint).

    Large and small stars alternate until nothing changes: each round links every node to the
    smallest known node around it, so a chain of n nodes takes about log n rounds. There are never
    more links than at the start, but in the end all nodes of a component are linked to its
    smallest; joins on that node have one row on their other side, so a skewed part is split
    when it is met. A null end and a link of a node with itself are ignored; repeated links count once.
    most: how many links there are at most, if that is known.
    """
    both = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, seen = checkpointed(both.distinct(), most), None
    most = edges.count()
    while True:
        # large star: a node's larger neighbours are linked to its smallest neighbour
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node's smaller neighbours and itself are linked to the smallest of them
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        edges = checkpointed(small, most)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
