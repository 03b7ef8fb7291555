"""Queries and their SQL twins, registered side by side so that the two key sets can't drift."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) -> DataFrame, with the DuckDB SQL that gives the same rows."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "q_revenue_by_nation",
    """
    SELECT n_name, sum(CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18, 4)))::DOUBLE AS revenue, count(*) AS n_lines
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
    JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE r_name = 'ASIA' GROUP BY n_name
    """,
)
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region and nation are of fixed size, so Spark broadcasts them by their files' size; the rest shuffles on its keys."""
    t = lambda name: table(spark, sf_dir, name)
    home = t("nation").join(t("region").where(F.col("r_name") == "ASIA"), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = t("orders").join(t("customer").join(home, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    amount = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).cast("decimal(18,4)")
    return (
        t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("n_name").agg(F.sum(amount).cast("double").alias("revenue"), F.count("*").alias("n_lines"))
    )
