"""Connected components of an edge table by alternating large-star and small-star rounds, kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import counted
from .common import discard, materialize

#: Edges that one task writes at least, so that rounds over few edges are few tasks and files.
TASK_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component), a written table, for every node of the edges (a, b); component is the smallest node reachable.

    Each round is grouped aggregation: every node's smallest neighbour m, then edges to m.  A hub's edges meet by a join
    that the adaptive planner can split; no neighbour list is ever collected.  Ends when the edges no longer change.
    Edges with a null end and loops are ignored; repeated edges count once; no edges give an empty table.
    """
    now, n = counted(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    fewer = lambda df: df.coalesce(max(1, -(-n // TASK_EDGES)))  # noqa: E731  (n never grows: a node's edges all go to one place)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours move to the smallest node known here
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours, and the node itself, move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(
            low.select("a", F.col("m").alias("b"))).distinct()
        old, now = now, materialize(fewer(small), "edges")
        discard(old)
        sign = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(sign) == seen:
            found = materialize(fewer(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())), "components")
            discard(now)
            return found
        seen = tuple(sign)
