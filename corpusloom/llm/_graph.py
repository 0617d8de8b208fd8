"""Connected components by alternating star contraction; linear space, logarithmic rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._store import Scratch


def _both(e: DataFrame) -> DataFrame:
    return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(e: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """Large star links each larger neighbour of a node to the least of its neighbourhood; small star the others. Frees e."""
    side = _both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Written, so that the join below deals out both sides itself and can split a node that has most edges.
    least = scratch.save(side.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    j = side.join(least, "a")
    if large:
        out = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    # The large star gives a row for each edge at most, so only the small one needs to drop repeats.
    out = out.where("a <> b")
    out = scratch.save(out if large else out.distinct(), "edges")
    scratch.drop(least, e)
    return out


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a lesser node, or is only a centre of such edges."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0)))
    return odd.isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(a long, b long) -> (node, root): root is the least node of the component.

    Each round is written to the shared folder, and what it was made from is freed. It ends when the edges are stars: as
    rounds keep what is connected, each star is a component then, and its centre is the least node. No edge comes to the driver.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_stars(now):
        now = _star(_star(now, True, scratch), False, scratch)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
