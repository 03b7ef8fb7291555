"""Aggregations that need more than one groupBy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.names import free, fresh


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank, from 1; give a unique last order column.

    Spark limits each task's groups before the shuffle (a window group limit), so a hot group sends k rows a task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(free(df.columns, name), F.row_number().over(w)).where(F.col(name) <= k)


def exact_distinct_by_group(df: DataFrame, by: Sequence[str], column: str, name: str) -> DataFrame:
    """count(DISTINCT column) by group in two sums: pairs first, which spreads a hot group over its values."""
    return df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*")).groupBy(*by).agg(F.count("*").alias(name))


def rollup_to_buckets(df: DataFrame, time: str, width: str, by: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates by time bucket (such as '1 hour') and further columns; the bucket's start is ``bucket``."""
    return df.groupBy(F.window(F.col(time).cast("timestamp"), width)["start"].alias("bucket"), *by).agg(*aggregates)


def sessions(df: DataFrame, by: Sequence[str], time: str, gap_seconds: int, name: str = "session", step: Column | None = None) -> DataFrame:
    """df with ``session`` (or another name), which goes up after each pause of more than ``gap_seconds`` of a key.

    Rows of equal time are of one session; rows of null time come before the first.  Nulls in ``by`` are a key of their own.  ``step`` cuts keys
    with very many rows: an expression over the time column that never falls as time grows, such as its day.  Each step of a key is then
    a window of its own; what passes from one to the next, its last time and its number of sessions, is one row a step.
    """
    key, us, mark, last, earlier = fresh([*df.columns, name], "key", "us", "new", "last", "earlier")
    # one column that is never null, so that nulls meet in joins too
    fields = [F.col(b).alias(f"k{i}") for i, b in enumerate(by)]
    rows = df.withColumn(free(df.columns, name), F.lit(0).cast("long")).withColumn(key, F.struct(*fields, (F.lit(0) if step is None else step).alias("step")))
    rows = rows.withColumn(us, F.unix_micros(F.col(time).cast("timestamp")))
    w = Window.partitionBy(key).orderBy(us)
    over_steps = Window.partitionBy(*[F.col(key)[f"k{i}"] for i in range(len(by))]).orderBy(F.col(key)["step"])
    before = F.lag(us).over(w)
    if step is not None:
        ends = rows.groupBy(key).agg(F.max(us).alias(last)).withColumn(last, F.lag(last).over(over_steps))
        rows, before = rows.join(ends, key), F.coalesce(before, F.col(last))
    rows = rows.withColumn(mark, F.when(F.col(us) - before > gap_seconds * 1_000_000, 1).otherwise(0))
    number = F.sum(mark).over(w)  # up to all rows of the same time
    if step is not None:
        sums = rows.groupBy(key).agg(F.sum(mark).alias(earlier))
        sums = sums.withColumn(earlier, F.coalesce(F.sum(earlier).over(over_steps.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        rows, number = rows.join(sums, key), number + F.col(earlier)
    return rows.withColumn(name, number).select(*df.columns, name)
