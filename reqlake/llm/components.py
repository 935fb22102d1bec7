"""Connected components of an edge table by alternating star contraction, as joins and aggregates only.

Each round hangs every node's neighbours on the smallest of them (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014).  No node's neighbour list is ever gathered; both steps aggregate with a map-side minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest neighbour of that node (itself included)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    moved = both.where("b > a").join(least, F.col("a") == F.col("u"))
    return moved.select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them; edges are (a, b) with a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m")
    moved = edges.join(least, F.col("b") == F.col("u")).select(F.col("m").alias("m"), F.col("a").alias("x"))
    own = least.select("m", F.col("u").alias("x"))
    return moved.union(own).where("m < x").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node of its component.

    ``edges`` has long columns a and b; order and repeats do not matter and loops are ignored.  An empty table gives
    no rows.  Rounds: O(log^2 n) at worst, two to four where components are stars already.
    """
    work = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    work = scratch.save(work, f"{name}-0")
    seen, turn = None, 0
    while True:
        check = work.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if check[0] == 0 or check == seen:
            return work.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                work.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        seen, turn = check, turn + 1
        work = scratch.save(_small(_large(work)), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
