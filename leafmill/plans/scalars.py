"""Queries of the column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import scalar
from leafmill.plans.registry import query, table


@query(
    "f_strings",
    """
    SELECT p_partkey, upper(p_name) AS up, length(p_name) AS n, reverse(p_brand) AS rev, lpad(CAST(p_size AS VARCHAR), 5, '0') AS padded, replace(p_type, 'E', 'e') AS replaced,
      split_part(p_name, ' ', 1) AS first, levenshtein(p_brand, 'Brand#11') AS distance, md5(p_name) AS digest, substr(p_name, 2, 4) AS part, p_name LIKE '%a%' AS has_a,
      regexp_extract(p_brand, '([0-9]+)', 1) AS digits FROM part
    """,
)
def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.upper(name).alias("up"),
        F.length(name).cast("long").alias("n"),
        F.reverse("p_brand").alias("rev"),
        F.lpad(F.col("p_size").cast("string"), 5, "0").alias("padded"),
        F.replace("p_type", F.lit("E"), F.lit("e")).alias("replaced"),
        F.split_part(name, F.lit(" "), F.lit(1)).alias("first"),
        F.levenshtein("p_brand", F.lit("Brand#11")).cast("long").alias("distance"),
        F.md5(name).alias("digest"),
        F.substring(name, 2, 4).alias("part"),
        name.like("%a%").alias("has_a"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"),
    )


@query(
    "f_dates",
    """
    SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy, date_trunc('month', o_orderdate)::TIMESTAMP AS month_start,
      date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS days, strftime(o_orderdate, '%Y-%m') AS label, last_day(o_orderdate)::DATE AS month_end FROM orders
    """,
)
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, long = F.col("o_orderdate"), lambda c: c.cast("long")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        long(F.year(d)).alias("y"),
        long(F.month(d)).alias("m"),
        long(F.quarter(d)).alias("q"),
        long(F.dayofyear(d)).alias("doy"),
        F.date_trunc("month", d).cast("timestamp_ntz").alias("month_start"),
        long(F.datediff(d, F.lit("1995-01-01").cast("date"))).alias("days"),
        F.date_format(d, "yyyy-MM").alias("label"),
        F.last_day(d).alias("month_end"),
    )


@query(
    "f_numbers",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))::DOUBLE AS net, floor(l_quantity)::BIGINT AS fl, ceil(l_tax * 100)::BIGINT AS ce, abs(l_quantity - 25) AS ab,
      (l_partkey % 7)::BIGINT AS md, round(sqrt(l_quantity), 6) AS root, round(ln(l_extendedprice), 6) AS logarithm, greatest(l_tax, l_discount) AS gr, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size,
      nullif(l_linestatus, 'F') AS open FROM lineitem
    """,
)
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        (price.cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("net"),
        F.floor(q).alias("fl"),
        F.ceil(F.col("l_tax") * 100).alias("ce"),
        F.abs(q - 25).alias("ab"),
        (F.col("l_partkey") % 7).alias("md"),
        F.round(F.sqrt(q), 6).alias("root"),
        F.round(F.log(price), 6).alias("logarithm"),
        F.greatest("l_tax", "l_discount").alias("gr"),
        F.when(q > 25, "big").otherwise("small").alias("size"),
        F.nullif("l_linestatus", F.lit("F")).alias("open"),
    )


@query("f_json", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"].alias("k")
    return table(spark, sf_dir, "events").groupBy(k).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    "f_arrays",
    """
    SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, round(list_max(embedding)::DOUBLE, 6) AS hi, len(list_filter(embedding, lambda x: x > 0)) AS positive,
      round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM embeddings
    """,
)
def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.size(e).cast("long").alias("dims"),
        F.round(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"),
        F.round(F.array_max(e).cast("double"), 6).alias("hi"),
        F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"),
        F.round(scalar.norm(e), 5).alias("norm"),
    )


@query(
    "f_words",
    """
    SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
    GROUP BY word HAVING count(*) >= 50
    """,
)
def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(scalar.bag_of_words(F.col("text"))).alias("word"))
    per = rows.groupBy("word", "doc_id").agg(F.count("*").alias("_n"))
    return per.groupBy("word").agg(F.sum("_n").alias("n"), F.count("*").alias("n_docs")).where("n >= 50")


@query(
    "f_maps",
    """
    SELECT lang, upper(source) AS source, n * 10 + 1 AS n, count(*) OVER (PARTITION BY lang) AS n_kept, n_all, has_first, most FROM (
      SELECT lang, source, count(*) AS n, count(*) OVER (PARTITION BY lang) AS n_all, bool_or(source = 'src0') OVER (PARTITION BY lang) AS has_first, max(count(*)) OVER (PARTITION BY lang) AS most
      FROM documents GROUP BY lang, source) WHERE n % 2 = 1
    """,
)
def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps made of groups, filtered, their keys and values changed, and asked for keys, values and size."""
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    packed = counts.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("m"))
    kept = F.map_filter("m", lambda k, v: v % 2 == 1)
    changed = F.transform_values(F.transform_keys(kept, lambda k, v: F.upper(k)), lambda k, v: v * 10 + 1)
    asked = packed.select(
        "lang",
        F.size(kept).cast("long").alias("n_kept"),
        F.size(F.map_keys("m")).cast("long").alias("n_all"),
        F.map_contains_key("m", "src0").alias("has_first"),
        F.array_max(F.map_values("m")).alias("most"),
        changed.alias("m"),
    )
    return asked.select("lang", "n_kept", "n_all", "has_first", "most", F.explode("m").alias("source", "n"))


@query(
    "f_pages",
    """
    SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a ')) AS n_links FROM pages
    """,
)
def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), scalar.markup_title(html).alias("title"), F.size(F.regexp_extract_all(html, F.lit("<a "), F.lit(0))).cast("long").alias("n_links")
    )


@query(
    "f_conversations",
    """
    SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id
    """,
)
def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.array_join(F.transform(turns, lambda t: t["role"]), ">").alias("roles"), F.sum(F.length("text")).cast("long").alias("n_chars")
    )


@query("f_labels", "SELECT lang, quality::BIGINT AS quality, count(*) AS n, sum(toxic)::BIGINT AS n_toxic FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", F.col("quality").cast("long").alias("quality")).agg(F.count("*").alias("n"), F.sum("toxic").cast("long").alias("n_toxic"))


#: Nested JSON of an event: its properties with more around them; cut where the event's number is a multiple of nine.
_NESTED_SQL = """(SELECT event_id, event_type, CASE WHEN event_id % 9 = 0 THEN left(j, 12) ELSE j END AS j FROM (
  SELECT event_id, event_type, '{"props": ' || props || ', "user": {"id": ' || user_id || ', "tags": ["' || event_type || '", "t' || event_id % 3 || '"]}' || CASE WHEN event_id % 2 = 0 THEN ', "even": true' ELSE '' END || '}' AS j FROM events))"""


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.when(F.col("event_id") % 2 == 0, ', "even": true').otherwise("")
    text = F.concat(F.lit('{"props": '), "props", F.lit(', "user": {"id": '), F.col("user_id").cast("string"), F.lit(', "tags": ["'), "event_type", F.lit('", "t'), (F.col("event_id") % 3).cast("string"), F.lit('"]}'), even, F.lit("}"))
    cut = F.when(F.col("event_id") % 9 == 0, F.left(text, F.lit(12))).otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", "event_type", cut.alias("j"))


@query(
    "f_variant",
    f"""
    SELECT event_id, json_valid(j) AS valid, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.props.k')::BIGINT END AS k, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.user.id')::BIGINT END AS user_id,
      CASE WHEN json_valid(j) THEN json_extract_string(j, '$.user.tags[1]') END AS tag, CASE WHEN json_valid(j) THEN coalesce(json_extract_string(j, '$.even')::BOOLEAN, false) END AS even, CASE WHEN json_valid(j) THEN NULL::BIGINT END AS tag_number
    FROM {_NESTED_SQL}
    """,
)
def variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON parsed once to a variant, fields read from it by type; text that isn't JSON is null, and so is a field of another type."""
    rows = _nested(spark, sf_dir).withColumn("v", F.try_parse_json("j"))
    at = lambda path, kind: F.try_variant_get("v", path, kind)
    even = F.when(F.col("v").isNotNull(), F.coalesce(at("$.even", "boolean"), F.lit(False)))
    return rows.select("event_id", F.col("v").isNotNull().alias("valid"), at("$.props.k", "long").alias("k"), at("$.user.id", "long").alias("user_id"), at("$.user.tags[1]", "string").alias("tag"), even.alias("even"), at("$.user.tags[1]", "long").alias("tag_number"))


@query(
    "f_variant_schema",
    "SELECT event_type, 'OBJECT<even: BOOLEAN, props: OBJECT<k: BIGINT>, user: OBJECT<id: BIGINT, tags: ARRAY<STRING>>>' AS schema, count(*) AS n, count(*) FILTER (event_id % 9 = 0) AS damaged FROM events GROUP BY event_type",
)
def variant_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema that all of a group's variants fit, worked out by an aggregate."""
    rows = _nested(spark, sf_dir).withColumn("v", F.try_parse_json("j"))
    return rows.groupBy("event_type").agg(F.schema_of_variant_agg("v").alias("schema"), F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("damaged"))
