"""The corpus pipeline: stages over ``documents``, each written and read again before the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import exact_dedup, language_id, packing, secret_scan, setsketch_dedup
from leafmill.llm.common import ROW, all_but_one, identified, materialize, table, without


#: Rows and bytes of a batch: whole texts are wide rows, and an executor holds several batches for each of its tasks.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": 256, "spark.sql.execution.arrow.maxRecordsPerBatch": 256, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20}


def wide_rows(spark: SparkSession) -> None:
    """Lower the session's batches to ``BATCHES``; settings that are lower already stay.

    A stage's result is worked out after its function returns, so a stage leaves them so; ``run`` sets them back.
    """
    for key, most in BATCHES.items():
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language, or in none for sure, go: null texts and those without letters too.

    Rows are judged one by one, by a number of their own, so ids may repeat or be null.  An empty table stays empty.
    """
    wide_rows(spark)
    rows = identified(docs)
    found = language_id.identify(rows, language_id.fit_text_models(rows, id_col=ROW), id_col=ROW)
    return without(rows, found.where("not accepted").select("doc_id"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: that of most code points, then of the smallest id, one without id last.

    Null and blank texts are one group.  Rows repeated under one id are copies like any others.
    """
    wide_rows(spark)
    rows = identified(docs)
    groups = exact_dedup.exact_duplicates(rows, id_col=ROW).where("group_size > 1").select("doc_id", "keep_id")
    return without(rows, all_but_one(rows, groups, longest=True))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest id: shingles of five words, a similarity of 0.8 or more.

    Null and blank texts are near to nothing and stay.
    """
    wide_rows(spark)
    rows = identified(docs)
    groups = setsketch_dedup.near_duplicates(rows, words=5, percent=80, id_col=ROW).where("n_shingles > 0").select("doc_id", "component_id")
    return without(rows, all_but_one(rows, groups))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets are replaced by a mark; null texts stay null."""
    wide_rows(spark)
    return secret_scan.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and place; null texts are packed as empty ones, rows of one id each for itself."""
    wide_rows(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: Shingle sets, decoded keys and byte-pair merges are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the session's settings are as before when it returns."""
    before = {key: spark.conf.get(key) for key in BATCHES}
    try:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
