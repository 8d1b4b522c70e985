"""Connected components of a table of links, by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.exchange import drop, written


def _stars(links: DataFrame, down: bool) -> DataFrame:
    """Every node's neighbours (only the smaller ones if `down`) are linked to its least neighbour."""
    both = links if down else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    out = both.join(least, "a")
    if down:  # b < a: neighbours and the node itself
        out = out.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    else:  # larger neighbours
        out = out.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every linked node; the component is its least node.

    links has columns a and b of one ordered type. Each round reads and writes as many links as
    there are at most; the number of rounds grows with the logarithm of the number of nodes. A
    node with any number of links is only grouped by its least one, with partial aggregation.
    """
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    seen = None
    for _ in range(rounds):
        before, now = now, written(_stars(_stars(now, down=False), down=True))
        if seen:
            drop(before)
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == seen:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        seen = sums
    raise RuntimeError(f"no components after {rounds} rounds")
