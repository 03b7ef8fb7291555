"""Connected components of a link table by alternating stars, in Spark rounds that each cut the lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import materialize, release

#: Far beyond what alternating stars take (about the logarithm of the largest component, squared).
MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u, v) with u > v.

    large: every greater neighbour of a node is joined to the node's least one, itself included;
    small: the node and its lesser neighbours are.  Both keep the components.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first, so that Spark can split the hot node of a large star
        least = materialize(both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m")), "least")
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u")
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every node of links (u, v): the least id reachable.

    Loops, repeated links and nulls are left out; nodes without a link to another don't appear.
    What the driver sees of a round is one count and one checksum.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "components")
    # stars that all hang on their least node already: every u once, no u also a v
    for _ in range(MAX_ROUNDS):
        following = materialize(_stars(_stars(edges, large=True), large=False), "components")
        state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        done = state(following) == state(edges)
        release(edges)
        edges = following
        if done:
            break
    else:
        raise RuntimeError("the components didn't settle")
    # settled: every node but the least of its component is a u once, and v is that least
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
