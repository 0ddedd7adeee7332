"""Connected components of a graph given as pairs, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.shared import sized
from meterline.session import stored


def _signature(edges: DataFrame) -> tuple:
    """Number of edges, and a sum that changes with any of them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (longs ``a, b``), root being the smallest node reachable.

    Every round hangs the larger neighbours of a node on its smallest one, then the smaller ones,
    until nothing changes; the rounds grow with the logarithm of the longest chain. A round is two
    sums with map-side combine and two joins. The joins read stored tables on both sides, so that
    Spark may split the partition of a node with very many neighbours. Rows with a null end and
    loops are left out; no edges give no rows.
    """
    now = stored(
        edges.where("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    signature, before = _signature(now), None
    while signature[0] and signature != before:
        before, n = signature, 2 * signature[0]  # no step has more rows than both directions of all edges
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(sized(
            both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), n), "least")
        large = stored(sized(
            both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct(), n), "edges")
        least = stored(sized(large.groupBy("a").agg(F.min("b").alias("m")), n), "least")
        now = stored(sized(
            large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.withColumnRenamed("m", "b")).distinct(), n), "edges")
        signature = _signature(now)
    # Every edge now runs from a node to the root of its component.
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
