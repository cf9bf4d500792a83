"""Connected components of a link table by alternating star steps, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _least(edges: DataFrame) -> DataFrame:
    """Adds low, the least of a node u and its neighbours v, to every row. The minimum combines on the map side; its key
    is wrapped so that both sides of the join are dealt by exchanges that adaptive execution can split."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.greatest("u", "u").alias("w"), F.least("u", "m").alias("low"))
    return edges.join(low, edges["u"] == low["w"]).select("u", "v", "low")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node of links; component is the least node that is reachable. Ends when a round changes
    nothing; the number of rounds grows with the logarithm of the longest path."""
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, last = written(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        small = _least(large)
        small = small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(small.select("u", F.col("low").alias("v")))
        edges = written(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    tops = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
