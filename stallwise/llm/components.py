"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Ties the neighbours of each node to the smallest of them.

    The large star moves the neighbours greater than the node, the small star
    the node and the smaller ones.  The minimum is combined before the shuffle;
    the neighbours of a hub meet it in a join, which Spark splits where it is hot.
    """
    sides = _both_ways(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("hub"), F.least("a", "m").alias("m"))
    met = sides.join(least, F.col("a") == F.col("hub"))
    moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.select("b", "m").unionAll(
        least.select("hub", "m")).toDF("a", "b")
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component``, the smallest node that can be reached, for every node of ``edges(a, b)``.

    Alternating large and small stars; each round is written to the shared
    folder, and the rounds end when the edges stay the same.  Loops and nulls
    are ignored, repeated edges count once, no edges give no rows.
    """
    now = written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        now = written(_star(_star(now, large=True), large=False), "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no components after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select("b", "b")).distinct()
