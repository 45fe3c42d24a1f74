"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmine.session import cut_lineage, drop_steps


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` of every id that has an edge to another; the root is the smallest id of the component.

    Each step replaces edges by edges to the smallest neighbour, so it works on single rows and a minimum per id: a hub
    of any degree needs no list of its neighbours. Steps end when nothing changes, after about log(n) of them.
    """
    edges = cut_lineage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    state = None
    while state != (now := _state(edges)):
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        # every edge leads down now; each id's lower neighbours and itself go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, cut_lineage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop_steps(before)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
