"""Helpers of the operators' tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def docs(spark: SparkSession, texts, first: int = 1) -> DataFrame:
    """documents of these texts with ids from ``first`` on; or of (id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
    full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")


def by_id(df: DataFrame, key: str = "doc_id") -> dict:
    return {r[key]: r.asDict() for r in df.collect()}


def read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns whose names an operator might use itself.
CLASHING = ["row_id", "fingerprint", "block", "_block", "key", "_class", "bands", "edges", "node", "kept", "span", "score", "part"]


def with_clashes(df: DataFrame) -> DataFrame:
    """df with columns that have an operator's names, and its own names in another case."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in (*CLASHING, *(c.upper() for c in df.columns))])
