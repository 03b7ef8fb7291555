"""Sinks and sources: tables written in each format and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.plans.registry import query, table
from leafmill.sources import documents
from leafmill.sources.scratch import new_path

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_SCHEMA = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*_COLUMNS)


@query("io_csv", _ORDERS)
def csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "csv")
    _orders(spark, sf_dir).write.option("header", "true").csv(path)
    return documents.read_csv(spark, path, _SCHEMA)


@query("io_json", _ORDERS)
def json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "json")
    _orders(spark, sf_dir).write.json(path)
    return spark.read.schema(_SCHEMA).json(path)


@query("io_orc", _ORDERS)
def orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "orc")
    _orders(spark, sf_dir).write.orc(path)
    return spark.read.schema(_SCHEMA).orc(path)


@query("io_partitioned", _ORDERS + " WHERE o_orderstatus = 'F'")
def partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter prunes folders: files of other states aren't opened."""
    path = new_path(spark, "partitioned")
    _orders(spark, sf_dir).write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.schema(_SCHEMA).parquet(path).where("o_orderstatus = 'F'").select(*_COLUMNS)


@query("io_text", "SELECT c_name AS value FROM customer")
def text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "text")
    table(spark, sf_dir, "customer").select(F.col("c_name").alias("value")).write.text(path)
    return spark.read.text(path)


@query("io_xml", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "xml")
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name").write.option("rowTag", "nation").xml(path)
    return spark.read.option("rowTag", "nation").schema("n_nationkey long, n_name string").xml(path)
