"""What the operators share: tables in the shared folder, arguments checks and Arrow helpers."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from leafmill.sources.scratch import new_path

#: Bytes that count as white space in every contract here: space and TAB to CR.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: a cut in the lineage that outlives any executor.

    The files go when the application ends, or earlier by ``release``.
    """
    spark = df.sparkSession
    path, schema = new_path(spark, label), df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._leafmill_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``materialize`` that no later step reads; other DataFrames are passed over."""
    for df in tables:
        if not getattr(df, "_leafmill_path", None):
            continue
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(df._leafmill_path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """df with columns called _0, _1 and so on, which no other names can clash with, whatever their case."""
    return df.toDF(*(f"_{i}" for i in range(len(df.columns))))


def place(df: DataFrame, name: str) -> str:
    """What ``numbered`` calls a column: that of exactly this name, else the first of it in another case."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        for i, c in enumerate(df.columns):
            if same(c):
                return f"_{i}"
    raise ValueError(f"no column {name} among {df.columns}")


def picked(df: DataFrame, **columns: str | None) -> DataFrame:
    """The columns that an operator reads, under the operator's own names; nulls for those that aren't given."""
    return numbered(df).select(*(F.col(place(df, c)).alias(n) if c else F.lit(None).cast("string").alias(n) for n, c in columns.items()))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: Rows of ids that may be broadcast: tables of 16 to 40 MB.
MAX_BROADCAST_IDS = 1_000_000


def bounded(ids: DataFrame) -> DataFrame:
    """ids, a written table of an id and at most a key beside it, marked for broadcast if it is counted to have at most ``MAX_BROADCAST_IDS`` rows."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


#: A row's own number, in tables of ``identified``.
ROW = "_leafmill_row"


def identified(docs: DataFrame) -> DataFrame:
    """docs with ``ROW``, a number for each row that is the same whenever the table is read.

    Rows of Parquet files are numbered by their file and place in it; any other table is written with numbers first.
    """
    own = [f"_{i}" for i in range(len(docs.columns))]
    try:
        rows = docs.select("*", F.col("_metadata.file_path"), F.col("_metadata.row_index")).toDF(*own, "_at", "_place")
    except AnalysisException:
        return materialize(numbered(docs).withColumn("_row", F.monotonically_increasing_id()), "numbered").toDF(*docs.columns, ROW)
    # a row for each file of the table, which the driver has listed anyway
    found = rows.select("_at").distinct().collect()
    files = docs.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(sorted(found))], "_file string, _no long")
    return rows.join(F.broadcast(files), F.col("_at") == F.col("_file")).select(*own, F.expr("shiftleft(_no, 40) + _place")).toDF(*docs.columns, ROW)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``identified`` docs less the rows whose ``ROW`` is the first column of ``dropped``, and without ``ROW``.

    Few numbers are broadcast, so no text is shuffled; more are joined through a shuffle.
    """
    ids = materialize(dropped.toDF("_dropped").distinct(), "dropped")
    return docs.join(bounded(ids), F.col(ROW) == F.col("_dropped"), "left_anti").drop(ROW)


def all_but_one(docs: DataFrame, groups: DataFrame, longest: bool = False) -> DataFrame:
    """Numbers of the rows of ``identified`` docs that aren't the first of their group; ``groups`` are (number, group).

    First is the row of the smallest id, one that has none last, then of the least number; of the longest texts if asked.
    """
    keys = picked(docs, row=ROW, id="doc_id", text="text")
    order = [-F.coalesce(F.char_length("text"), F.lit(0)) if longest else F.lit(0), F.col("id").isNull(), F.col("id"), F.col("row")]
    keys = keys.select(F.col("row").alias("_row"), F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order))).alias("_order"))
    groups = materialize(groups.toDF("_row", "_group"), "groups")
    best = groups.join(keys, "_row").groupBy("_group").agg(F.min("_order").alias("_best")).select(F.col("_best._3").alias("_row"))
    return groups.join(best, "_row", "left_anti").select("_row")


def in_order(df: DataFrame, keys: list[Column], part_rows: int, label: str) -> DataFrame:
    """df, a table that can be read twice, written in the order of keys, with the number of each row's range partition (pid) and its place there (k).

    A partition has about ``part_rows`` rows, whatever share of the table one key has; the last key should tell rows apart.
    """
    parts = max(1, math.ceil(df.count() / part_rows))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return materialize(ranged.select("*", F.shiftright("_at", 33).alias("pid"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("k")).drop("_at"), label)


#: Rows of a batch that are unpacked at once: what a task holds doesn't depend on the session's batch size.
SLICED_ROWS = 256


@contextmanager
def arrow_rows(spark: SparkSession, most: int = SLICED_ROWS) -> Iterator[None]:
    """At most so many rows in a batch that goes to Python, for what runs inside; the session's setting is as before then."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= most:
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, SLICED_ROWS):
            yield whole.slice(at, SLICED_ROWS)


def utf8(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8; null is empty."""
    return [v if v is not None else b"" for v in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return [v if v is not None else "" for v in column.to_pylist()]


def batch(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
