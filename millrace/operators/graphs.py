"""Recursion over edges of any number and depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut


def closure(edges: DataFrame, start: str, end: str, depth: str = "depth") -> DataFrame:
    """`start`, `end`, `depth` (bigint): all pairs that a path of one edge or more joins, with the edges of the shortest.

    Round k knows the pairs up to 2^k edges apart; longer ones, up to twice that, are a pair exactly 2^k apart followed
    by a known one. So there are as many rounds as the logarithm of the longest shortest path, each of them one join of
    whole tables with a checkpoint behind it; no limit of levels or rows stands against it, and circles end, since a
    known pair isn't made again (a node on a circle reaches itself). Repeated edges count once; edges with a null end
    are no edges; an empty table gives no rows. The result has a row for each pair, which the graph decides.
    """
    pairs = edges.select(F.col(start).alias("_a"), F.col(end).alias("_b")).dropna().distinct().withColumn("_d", F.lit(1).cast("long"))
    known, span = cut(pairs), 1
    while True:
        last = known.where(F.col("_d") == span).select("_a", F.col("_b").alias("_via"), F.col("_d").alias("_far"))
        onward = known.select(F.col("_a").alias("_via"), "_b", "_d")
        new = last.join(onward, "_via").groupBy("_a", "_b").agg(F.min(F.col("_far") + F.col("_d")).alias("_d"))
        new = cut(new.join(known.select("_a", "_b"), ["_a", "_b"], "left_anti"))
        if new.isEmpty():
            return known.select(F.col("_a").alias(start), F.col("_b").alias(end), F.col("_d").alias(depth))
        known, span = known.unionByName(new), 2 * span
