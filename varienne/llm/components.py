"""Union-find grouping of a link table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varienne.llm.store import materialize


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    Alternating large and small stars: in the first every node hands its larger neighbours to
    the smallest node it knows, in the second its smaller ones.  The link table stays at most as
    long as it was, every round is written to the shared folder, and the rounds needed grow with
    the logarithm of the longest chain.  Minima are combined before the shuffle and the join that
    follows may split a node with very many links.  Links with a null end or from a node to itself
    are ignored; an empty table gives an empty result.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least.select("u", F.least("u", "m").alias("m")), "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # Every remaining link points to a smaller node: the node and its other neighbours go to the smallest.
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.*").where("u <> v").distinct(), "links")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("bigint")).alias("h")).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
