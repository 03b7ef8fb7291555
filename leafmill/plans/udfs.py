"""User functions of each kind; all run on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from leafmill.plans.registry import query, table


@query("u_pandas", "SELECT o_orderkey, round(o_totalprice * 1.19, 4) AS gross FROM orders")
def pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def gross(price: pd.Series) -> pd.Series:
        return price * 1.19

    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(gross("o_totalprice"), 4).alias("gross"))


@query("u_grouped_map", "SELECT c_nationkey, count(*) AS n, round(max(c_acctbal) - min(c_acctbal), 4) AS span FROM customer GROUP BY 1")
def grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def span(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        balance = pdf["c_acctbal"]
        return pd.DataFrame({"c_nationkey": [key[0]], "n": [len(pdf)], "span": [round(balance.max() - balance.min(), 4)]})

    return table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal").groupBy("c_nationkey").applyInPandas(span, "c_nationkey int, n long, span double")


@query("u_batch_map", "SELECT event_id, value > 100 AS big FROM events WHERE event_type = 'purchase'")
def batch_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"event_id": frame["event_id"], "big": frame["value"] > 100})

    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "value").mapInPandas(run, "event_id long, big boolean")


@query("u_scalar", "SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda w: w <> ''), lambda w: upper(w[1])), '') AS initials FROM part")
def scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of one value at a time, sent to it in Arrow batches."""

    @F.udf(returnType="string", useArrow=True)
    def initials(name: str | None) -> str | None:
        return None if name is None else "".join(word[0].upper() for word in name.split(" ") if word)

    return table(spark, sf_dir, "part").select("p_partkey", initials("p_name").alias("initials"))


@query("u_arrow_map", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 40 AND l_discount < 0.05")
def arrow_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record batches filtered as they are, without a pandas copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = pc.and_(pc.greater(batch["l_quantity"], 40), pc.less(batch["l_discount"], 0.05))
            yield batch.filter(kept).select(["l_orderkey", "l_linenumber", "l_quantity"])

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rows.mapInArrow(run, rows.select("l_orderkey", "l_linenumber", "l_quantity").schema)


@query("u_aggregate", "SELECT user_id, round(sum(value * value), 2) AS energy FROM events GROUP BY 1")
def aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def energy(v: pd.Series) -> float:
        return float((v * v).sum())

    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(energy("value"), 2).alias("energy"))


@query("u_table", "SELECT n_nationkey, unnest(range(0, n_nationkey % 3 + 1))::INT AS k FROM nation")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="k: int", useArrow=True)
    class Upto:
        def eval(self, n: int):
            for k in range(n % 3 + 1):
                yield (k,)

    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    return nations.lateralJoin(Upto(F.col("n_nationkey").outer())).select("n_nationkey", "k")


#: What ``Sessions`` and ``BatchSessions`` add to a table's columns.
NUMBERED = [StructField("session", LongType()), StructField("place", LongType())]


class Sessions:
    """Numbers each user's sessions; its rows are those of the table that it is given, and two more columns.

    The table has to be partitioned by user and ordered by time, which the call says.  It takes a row at a time, so Spark makes
    a record batch for each; ``BatchSessions`` is for tables of many rows.
    """

    def __init__(self) -> None:
        self.last, self.session, self.seen = None, 0, 0

    @staticmethod
    def analyze(events: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        if not events.isTable or not isinstance(gap.dataType, IntegerType):
            raise ValueError("sessions take a table and a number of seconds")
        return AnalyzeResult(StructType([*events.dataType.fields, *NUMBERED]))

    def eval(self, row: Row, gap: int) -> Iterator[tuple]:
        if self.last is not None:
            new = (row["ts"] - self.last).total_seconds() > gap
            self.session, self.seen = self.session + new, 0 if new else self.seen + 1
        self.last = row["ts"]
        yield (*row, self.session, self.seen)


class BatchSessions:
    """As ``Sessions``, on record batches as they come, of any size; a row without a time is of the session before it."""

    def __init__(self) -> None:
        self.last, self.session, self.seen = None, 0, -1

    def eval(self, rows: pa.RecordBatch, gap: pa.Array) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            ts = rows.column("ts").cast(pa.timestamp("us")).cast(pa.int64())
            us, missing, at = ts.fill_null(0).to_numpy(), ts.is_null().to_numpy(zero_copy_only=False), np.arange(len(ts))
            before = np.concatenate(([self.last or 0], us[:-1]))
            unknown = missing | np.concatenate(([self.last is None], missing[:-1]))
            new = ~unknown & (us - before > gap[0].as_py() * 1_000_000)
            session = self.session + np.cumsum(new)
            place = at - np.maximum.accumulate(np.where(new, at, -1 - self.seen))
            self.last, self.session, self.seen = None if missing[-1] else int(us[-1]), int(session[-1]), int(place[-1])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(session, pa.int64()), pa.array(place, pa.int64())], [*rows.schema.names, *(f.name for f in NUMBERED)])


def numbered_sessions(events: DataFrame, user: str, gap: int) -> DataFrame:
    """``events`` with session and place, numbers from 0 of each user's sessions by ``ts`` and of the rows in them; rows without a time come last."""
    function = F.arrow_udtf(BatchSessions, returnType=StructType([*events.schema.fields, *NUMBERED]))
    return function(events.asTable().partitionBy(user).orderBy(F.asc_nulls_last("ts")), F.lit(gap))


@query(
    "u_table_argument",
    """
    SELECT event_id, user_id, ts, session, row_number() OVER (PARTITION BY user_id, session ORDER BY ts) - 1 AS place FROM (
      SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
        SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 3600000000 THEN 1 ELSE 0 END AS new FROM events))
    """,
)
def table_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State within a partition of a table argument; the schema comes from the table."""
    return numbered_sessions(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", 3600)
