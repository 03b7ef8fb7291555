"""Joins, aggregations, windows and set operations over the star schema and the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators import aggregates, graphs, joins, sketches
from leafmill.plans.registry import query, table
from leafmill.sources.scratch import new_path

_MONEY = "decimal(18,4)"


@query(
    "q_pricing_summary",
    """
    SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(18,4)))::DOUBLE AS sum_qty,
      sum(CAST(l_extendedprice AS DECIMAL(18,4)))::DOUBLE AS sum_price, round(avg(l_discount), 6) AS avg_discount, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL
    """,
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast(_MONEY)).cast("double").alias("sum_qty"),
        F.sum(F.col("l_extendedprice").cast(_MONEY)).cast("double").alias("sum_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"),
        F.count("*").alias("n"),
    )


@query("j_left_outer", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counted before the join: orders shuffle once, as one row a customer
    counts = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("_n"))
    out = table(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce("_n", F.lit(0)).alias("n_orders"))


@query(
    "j_full_outer",
    """
    SELECT coalesce(c.k, s.k) AS nation, coalesce(c.n, 0) AS n_customers, coalesce(s.n, 0) AS n_suppliers
    FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k
    """,
)
def full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("_c"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("_s"))
    return c.join(s, "nation", "full").select("nation", F.coalesce("_c", F.lit(0)).alias("n_customers"), F.coalesce("_s", F.lit(0)).alias("n_suppliers"))


@query("j_right_outer", "SELECT s_suppkey, n_name FROM nation RIGHT JOIN supplier ON s_nationkey = n_nationkey AND n_regionkey = 2")
def right_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 2")
    return nations.join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


_SUPPLIED = "SELECT s_suppkey, count(*) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1"


def _supplied(spark: SparkSession, sf_dir: str, hint: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey")
    joined = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey").hint(hint), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("j_sort_merge", _SUPPLIED)
def sort_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplied(spark, sf_dir, "merge")


@query("j_shuffle_hash", _SUPPLIED)
def shuffle_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplied(spark, sf_dir, "shuffle_hash")


@query("j_theta", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON b.s_acctbal > a.s_acctbal AND b.s_acctbal < a.s_acctbal + 40")
def theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No equality at all: a range join, so that neither side is broadcast or crossed."""
    s = table(spark, sf_dir, "supplier")
    points, ranges = s.select(F.col("s_suppkey").alias("b"), "s_acctbal"), s.select(F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 40).alias("hi"))
    return joins.range_join(points, ranges, "s_acctbal", "lo", "hi", 40.0).where("s_acctbal > lo").select("a", "b")


@query("j_semi", "SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 49")
    return table(spark, sf_dir, "part").join(big, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


@query("j_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query(
    "j_correlated",
    "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.9 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
)
def correlated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated scalar subquery, which Spark turns into one aggregate and one join."""
    o, i = table(spark, sf_dir, "orders").alias("o"), table(spark, sf_dir, "orders").alias("i")
    mean = i.where(F.col("i.o_custkey") == F.col("o.o_custkey").outer()).select(F.avg("i.o_totalprice")).scalar()
    return o.where(F.col("o.o_totalprice") > 1.9 * mean).select("o_orderkey", "o_totalprice")


@query(
    "j_asof",
    """
    SELECT c.event_id, c.user_id, v.event_id AS asof_event_id
    FROM (SELECT * FROM events WHERE event_type = 'purchase') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts
    """,
)
def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    left, right = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return joins.asof_join(left, right, ["user_id"], "ts", ["event_id"], tie="event_id").select("event_id", "user_id", "asof_event_id")


@query(
    "j_asof_nulls",
    """
    WITH c AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 11 <> 0 THEN ts END AS ts FROM events WHERE event_type = 'click'),
    v AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 9 <> 0 THEN ts END AS ts FROM events WHERE event_type = 'view')
    SELECT c.event_id, c.user_id, v.event_id AS asof_event_id FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts
    """,
)
def asof_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and times that are null on either side match nothing."""
    kept = lambda c, n: F.when(F.col("event_id") % n != 0, F.col(c)).alias(c)
    sides = [table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("event_id", kept("user_id", a), kept("ts", b)) for kind, a, b in (("click", 10, 11), ("view", 7, 9))]
    return joins.asof_join(*sides, ["user_id"], "ts", ["event_id"], tie="event_id").select("event_id", "user_id", "asof_event_id")


@query(
    "j_asof_ties",
    """
    SELECT event_id, user_id, asof_event_id, asof_value FROM (
      SELECT c.event_id, c.user_id, v.event_id AS asof_event_id, v.value AS asof_value, row_number() OVER (PARTITION BY c.event_id ORDER BY v.h DESC NULLS LAST, v.event_id DESC) AS k
      FROM (SELECT *, date_trunc('day', ts) AS h FROM events WHERE event_type = 'purchase') c LEFT JOIN (SELECT *, date_trunc('day', ts) AS h FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.h >= v.h) WHERE k = 1
    """,
)
def asof_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times cut to days, so that many right rows tie: the one of the greatest number counts."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("day", "ts"))
    left, right = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("event_id", "user_id", "ts", "value")
    return joins.asof_join(left, right, ["user_id"], "ts", ["event_id", "value"], tie="event_id").drop("ts")


@query(
    "j_asof_steps",
    """
    SELECT event_id, k, asof_event_id FROM (
      SELECT event_id, event_type, k, last_value(CASE WHEN event_type <> 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts, (event_type = 'purchase')::INT, event_id ROWS UNBOUNDED PRECEDING) AS asof_event_id
      FROM (SELECT *, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS k FROM events WHERE event_type IN ('purchase', 'error'))) WHERE event_type = 'purchase'
    """,
)
def asof_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key holds a third of all rows: its hours are windows of their own, and most matches lie in an earlier hour."""
    e = table(spark, sf_dir, "events").withColumn("k", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    left, right = e.where("event_type = 'purchase'").select("event_id", "k", "ts"), e.where("event_type = 'error'").select("event_id", "k", "ts")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return joins.asof_join(left, right, ["k"], "ts", ["event_id"], tie="event_id", step=hour).select("event_id", "k", "asof_event_id")


def _tasks(spark: SparkSession) -> int:
    """Tasks for joins whose pairs grow faster than their rows: several for each core, so that none is long."""
    return 8 * spark.sparkContext.defaultParallelism


@query(
    "j_range",
    """
    SELECT p_partkey, b.lo AS lo, b.hi AS hi FROM part JOIN (SELECT (c_custkey % 50 * 40)::DOUBLE AS lo, (c_custkey % 50 * 40 + 25 + c_custkey % 7)::DOUBLE AS hi FROM customer) b
    ON p_retailprice >= b.lo AND p_retailprice < b.hi
    """,
)
def range_(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = (F.col("c_custkey") % 50 * 40.0).alias("lo")
    ranges = table(spark, sf_dir, "customer").select(lo, (F.col("c_custkey") % 50 * 40.0 + 25 + F.col("c_custkey") % 7).alias("hi"))
    points = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return joins.range_join(points, ranges, "p_retailprice", "lo", "hi", 30.0, tasks=_tasks(spark), repeated=True).select("p_partkey", "lo", "hi")


@query(
    "j_range_whole",
    """
    SELECT p_partkey, c_custkey FROM part JOIN (SELECT c_custkey, c_acctbal AS lo, c_acctbal + 1 + c_custkey % 3 AS hi FROM customer) b
    ON p_retailprice >= b.lo AND p_retailprice < b.hi
    """,
)
def range_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part and a narrow range of every customer, so that few pairs meet without a subset of ids."""
    ranges = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("lo"), (F.col("c_acctbal") + 1 + F.col("c_custkey") % 3).alias("hi"))
    points = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return joins.range_join(points, ranges, "p_retailprice", "lo", "hi", 1.0, tasks=_tasks(spark)).select("p_partkey", "c_custkey")


@query(
    "j_range_totals",
    """
    SELECT c_custkey, count(p_partkey) AS n, coalesce(sum(p_size), 0)::BIGINT AS total
    FROM customer LEFT JOIN part ON p_retailprice >= c_acctbal AND p_retailprice < c_acctbal + 200 + c_custkey % 7 * 100 GROUP BY c_custkey
    """,
)
def range_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and size of the parts in each customer's range of prices: ranges hold many parts, pairs aren't made."""
    ranges = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("lo"), (F.col("c_acctbal") + 200 + F.col("c_custkey") % 7 * 100).alias("hi"))
    parts = table(spark, sf_dir, "part").select("p_retailprice", F.col("p_size").cast("long").alias("p_size"))
    return joins.range_totals(parts, ranges, "p_retailprice", "lo", "hi", 10.0, value="p_size").select("c_custkey", "n", "total")


@query(
    "j_interval",
    """
    SELECT a.event_id AS click, b.event_id AS error FROM events a JOIN events b ON a.user_id = b.user_id
    WHERE a.event_type = 'click' AND b.event_type = 'error' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 1800 * 1000000
    """,
)
def interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("click_ts"))
    b = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error"), F.col("ts").alias("error_ts"))
    return joins.interval_join(a, b, ["user_id"], "click_ts", "error_ts", 1800).select("click", "error")


@query("j_salted", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey").hint("shuffle_hash")
    return joins.salted_join(table(spark, sf_dir, "customer"), nations, ["c_nationkey"], 8, F.col("c_custkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query(
    "j_lateral",
    "SELECT c_custkey, o.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o",
)
def lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lateral subquery with a limit, which Spark turns into a window with a group limit before the shuffle."""
    own = table(spark, sf_dir, "orders").where(F.col("o_custkey") == F.col("c.c_custkey").outer())
    best = own.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(2)
    return table(spark, sf_dir, "customer").alias("c").lateralJoin(best).select("c_custkey", "o_orderkey")


@query(
    "a_statistics",
    """
    SELECT c_mktsegment, count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, round(stddev_samp(c_acctbal), 4) AS sd, round(median(c_acctbal), 4) AS med,
      round(quantile_cont(c_acctbal, 0.9), 4) AS p90, count(DISTINCT c_nationkey) AS n_nations, max_by(c_name, c_acctbal) AS richest
    FROM customer GROUP BY c_mktsegment
    """,
)
def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.count("*").alias("n"),
        F.min("c_acctbal").alias("lo"),
        F.max("c_acctbal").alias("hi"),
        F.round(F.stddev_samp("c_acctbal"), 4).alias("sd"),
        F.round(F.median("c_acctbal"), 4).alias("med"),
        F.round(F.percentile("c_acctbal", 0.9), 4).alias("p90"),
        F.count_distinct("c_nationkey").alias("n_nations"),
        F.max_by("c_name", "c_acctbal").alias("richest"),
    )


_GROUPED = """
    SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus)::BIGINT AS g_status, grouping(o_orderpriority)::BIGINT AS g_priority, count(*) AS n,
      sum(CAST(o_totalprice AS DECIMAL(18,4)))::DOUBLE AS total FROM orders GROUP BY {}
    """


def _grouped(df: DataFrame) -> DataFrame:
    return df.agg(
        F.grouping("o_orderstatus").cast("long").alias("g_status"),
        F.grouping("o_orderpriority").cast("long").alias("g_priority"),
        F.count("*").alias("n"),
        F.sum(F.col("o_totalprice").cast(_MONEY)).cast("double").alias("total"),
    )


@query("a_cube", _GROUPED.format("CUBE (o_orderstatus, o_orderpriority)"))
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority"))


@query("a_rollup", _GROUPED.format("ROLLUP (o_orderstatus, o_orderpriority)"))
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority"))


@query("a_grouping_sets", _GROUPED.format("GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"))
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [[F.col("o_orderstatus")], [F.col("o_orderpriority")], []]
    return _grouped(table(spark, sf_dir, "orders").groupingSets(sets, F.col("o_orderstatus"), F.col("o_orderpriority")))


@query(
    "a_pivot",
    """
    SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P
    FROM orders GROUP BY o_orderpriority
    """,
)
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query(
    "a_unpivot",
    "SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_discount FROM lineitem) UNPIVOT (value FOR name IN (l_quantity, l_tax, l_discount))",
)
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax", "l_discount"], "name", "value")


@query(
    "a_unpivot_whole",
    "SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem) UNPIVOT (value FOR name IN (l_quantity, l_tax))",
)
def unpivot_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"], "name", "value")


@query("a_distinct_by_group", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1")
def distinct_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.exact_distinct_by_group(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_partkey", "n_parts")


@query("a_collect", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY 1")
def collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("a_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


@query(
    "a_time_bucket",
    "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def time_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.rollup_to_buckets(table(spark, sf_dir, "events"), "ts", "6 hours", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("a_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


@query("a_duplicate_texts", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the shuffle carries digests, not texts
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("a_approximate")
def approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches: their answers are Spark's own, so SQL elsewhere can't repeat them; the tests bound their errors."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("n_parts"), F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("median_price")
    )


@query(
    "w_ranking",
    """
    SELECT p_partkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(4) OVER w AS quarter, round(cume_dist() OVER v, 8) AS cd, round(percent_rank() OVER v, 8) AS pr
    FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey), v AS (PARTITION BY p_brand ORDER BY p_size)
    """,
)
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, v = Window.partitionBy("p_brand").orderBy("p_size", "p_partkey"), Window.partitionBy("p_brand").orderBy("p_size")
    long = lambda c: c.cast("long")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        long(F.row_number().over(w)).alias("rn"),
        long(F.rank().over(v)).alias("rk"),
        long(F.dense_rank().over(v)).alias("dr"),
        long(F.ntile(4).over(w)).alias("quarter"),
        F.round(F.cume_dist().over(v), 8).alias("cd"),
        F.round(F.percent_rank().over(v), 8).alias("pr"),
    )


@query(
    "w_analytic",
    """
    SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after, first_value(event_id) OVER w AS first, nth_value(event_id, 2) OVER w AS second,
      round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS moving
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
    """,
)
def analytic(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.lag("event_id").over(w).alias("before"),
        F.lead("event_id", 2).over(w).alias("after"),
        F.first("event_id").over(w).alias("first"),
        F.nth_value("event_id", 2).over(w).alias("second"),
        F.round(F.sum("value").over(w.rowsBetween(-3, 0)), 4).alias("moving"),
    )


@query(
    "w_range_frame",
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events",
)
def range_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("_us").rangeBetween(-3_600_000_000, 0)
    return table(spark, sf_dir, "events").withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", F.count("*").over(w).alias("n"))


@query("w_top_k", "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2)
    return out.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query(
    "w_sessions",
    """
    SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
      SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 3600000000 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY ALL
    """,
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 3600).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query(
    "w_sessions_steps",
    """
    SELECT k, session, count(*) AS n, min(ts) AS start FROM (SELECT k, ts, sum(new) OVER (PARTITION BY k ORDER BY ts)::BIGINT AS session FROM (
      SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY k ORDER BY ts) > 600000000 THEN 1 ELSE 0 END AS new
      FROM (SELECT ts, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS k FROM events))) GROUP BY ALL
    """,
)
def sessions_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key holds a third of all rows: its hours are windows of their own, its sessions go on from hour to hour."""
    e = table(spark, sf_dir, "events").select("ts", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")).alias("k"))
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return aggregates.sessions(e, ["k"], "ts", 600, step=hour).groupBy("k", "session").agg(F.count("*").alias("n"), F.min("ts").alias("start"))


@query("s_sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(10).limit(25)


#: Whole tables; by nation and steps of balance there are values that only one side has.
_SET = "SELECT c_nationkey AS k, floor(c_acctbal / {step})::BIGINT AS {name} FROM customer {set} SELECT s_nationkey AS k, floor(s_acctbal / {step})::BIGINT AS {name} FROM supplier"


def _set_sides(spark: SparkSession, sf_dir: str, step: int, name: str) -> list[DataFrame]:
    return [
        table(spark, sf_dir, t).select(F.col(f"{x}_nationkey").alias("k"), F.floor(F.col(f"{x}_acctbal") / step).cast("long").alias(name))
        for t, x in (("customer", "c"), ("supplier", "s"))
    ]


for _name, _sql, _method in (
    ("s_union", "UNION", lambda a, b: a.union(b).distinct()),
    ("s_union_all", "UNION ALL", lambda a, b: a.union(b)),
    ("s_intersect", "INTERSECT", lambda a, b: a.intersect(b)),
    ("s_intersect_all", "INTERSECT ALL", lambda a, b: a.intersectAll(b)),
    ("s_except", "EXCEPT", lambda a, b: a.subtract(b)),
    ("s_except_all", "EXCEPT ALL", lambda a, b: a.exceptAll(b)),
):
    for _suffix, _step, _column in (("", 250, "quarters"), ("_whole", 1000, "thousands")):
        query(_name + _suffix, _SET.format(set=_sql, step=_step, name=_column))(lambda spark, sf_dir, _m=_method, _s=_step, _c=_column: _m(*_set_sides(spark, sf_dir, _s, _c)))


@query(
    "s_recursive",
    """
    WITH RECURSIVE edges AS (SELECT DISTINCT o_custkey AS src, following AS dst FROM (SELECT o_custkey, lead(o_custkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS following FROM orders WHERE o_orderstatus = 'P') WHERE following IS NOT NULL),
    reach(node, hops) AS (SELECT c_custkey, 0 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0 UNION SELECT dst, hops + 1 FROM reach JOIN edges ON src = node WHERE hops < 100)
    SELECT node, min(hops) AS hops FROM reach GROUP BY node
    """,
)
def recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that others lead to, from order to order of a day: a graph with cycles, walked to its end."""
    following = F.lead("o_custkey").over(Window.partitionBy("o_orderdate").orderBy("o_orderkey"))
    edges = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("src"), following.alias("dst"))
    start = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal < 0").select("c_custkey")
    return graphs.reached(start, edges)


@query(
    "a_sketch_rollup",
    """
    SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS hll_near, true AS theta_near, true AS median_near, true AS as_unmerged, true AS both_near FROM events GROUP BY event_type
    """,
)
def sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each day and type, stored, merged over the days: near the exact values, and as those of the whole types at once.

    both_near: users of the type that also have clicks, by the intersection of two sketches.
    """
    e = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    stored = new_path(spark, "sketches")
    sketches.sketched(e, ["day", "event_type"], "user_id", "value").write.parquet(stored)
    rolled = sketches.merged(spark.read.parquet(stored), ["event_type"])
    whole = sketches.estimated(sketches.sketched(e, ["event_type"], "user_id", "value")).select("event_type", F.col("theta_distinct").alias("_theta"), F.col("hll_distinct").alias("_hll"))
    clicks = rolled.where("event_type = 'click'").select(F.col("theta").alias("_clicks"))
    # one row of a bounded sketch becomes a literal
    (one,) = clicks.first() or (None,)
    both = F.theta_sketch_estimate(F.theta_intersection("theta", F.lit(bytes(one)) if one is not None else F.col("theta")))
    found = sketches.estimated(rolled.withColumn("both", both))
    users = e.groupBy("event_type", "user_id").agg(F.count("*").alias("k"))
    clickers = users.where("event_type = 'click'").select("user_id", F.lit(1).alias("_clicked"))
    exact = users.join(clickers, "user_id", "left").groupBy("event_type").agg(F.count("*").alias("users"), F.count("_clicked").alias("_both"))
    ranks = e.join(found.select("event_type", "q50"), "event_type").groupBy("event_type").agg(F.avg((F.col("value") <= F.col("q50")).cast("int")).alias("_rank"))
    near = lambda a, b, by: F.abs(F.col(a) - F.col(b)) <= by * F.col(b)
    return found.join(whole, "event_type").join(exact, "event_type").join(ranks, "event_type").select(
        "event_type", "n", "users", near("hll_distinct", "users", 0.08).alias("hll_near"), near("theta_distinct", "users", 0.08).alias("theta_near"), (F.abs(F.col("_rank") - 0.5) <= 0.03).alias("median_near"),
        ((F.col("hll_distinct") == F.col("_hll")) & near("theta_distinct", "_theta", 0.04)).alias("as_unmerged"), near("both", "_both", 0.12).alias("both_near"),
    )
