"""Recursion over tables: a frontier that is expanded until nothing new is reached."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.sources.scratch import new_path

#: Rounds whose tables are read side by side before they are written as one.
TABLES = 16


def _written(df: DataFrame, label: str) -> DataFrame:
    path, schema = new_path(df.sparkSession, label), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def reached(start: DataFrame, edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(node, hops) of every node that edges (src, dst) lead to from the nodes of ``start``, with the fewest edges passed.

    Each round joins only the nodes found by the one before, drops those known, and is written to the shared folder, so the plan doesn't grow and a
    lost executor costs its tasks only.  Cycles, loops and repeated edges end as they add nothing; nulls lead
    nowhere.  A node with very many edges is split by Spark, as both sides are written tables.
    """
    edges = _written(edges.dropna(subset=["src", "dst"]).select("src", "dst").distinct(), "edges")
    new = _written(start.dropna().select(F.col(start.columns[0]).alias("node"), F.lit(0).alias("hops")).distinct(), "frontier")
    tables, hops = [new], 0
    while max_hops is None or hops < max_hops:
        hops += 1
        known = reduce(DataFrame.unionByName, tables)
        step = new.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        new = _written(step.join(known.select("node"), "node", "left_anti").withColumn("hops", F.lit(hops)), "frontier")
        if new.isEmpty():
            break
        tables.append(new)
        if len(tables) > TABLES:
            tables = [_written(reduce(DataFrame.unionByName, tables), "reached")]
    return reduce(DataFrame.unionByName, tables)
