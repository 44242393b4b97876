"""Queries of the aggregate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import aggregates as A
from tidewell.plans.common import LOGS, PLACES, offer_log
from tidewell.plans.registry import query
from tidewell.plans.relational import GAPPY, gappy_orders
from tidewell.tables import load


def mean_sql(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(24,4))) AS DOUBLE) / count({column})"


@query("table_shape", """
SELECT count(*) AS row_count, CAST((SELECT count(*) FROM (DESCRIBE lineitem)) AS INTEGER) AS column_count FROM lineitem""")
def table_shape(spark, d):
    return A.table_shape(load(spark, d, "lineitem"))


@query("null_profile", f"""
WITH {GAPPY}, n AS (SELECT count(*) - count(COLUMNS(*)) FROM gappy)
SELECT column_name, null_count FROM (UNPIVOT n ON COLUMNS(*) INTO NAME column_name VALUE null_count)""")
def null_profile(spark, d):
    return A.null_profile(gappy_orders(spark, d))


@query("distinct_values", "SELECT DISTINCT p_brand FROM part")
def distinct_values(spark, d):
    return A.distinct_values(load(spark, d, "part"), "p_brand")


@query("distinct_count", "SELECT count(DISTINCT l_partkey) AS n_distinct FROM lineitem")
def distinct_count(spark, d):
    return A.distinct_count(load(spark, d, "lineitem"), "l_partkey")


@query("group_avg_median", f"""
SELECT l_returnflag, {mean_sql('l_extendedprice')} AS mean, median(l_extendedprice) AS median FROM lineitem GROUP BY 1""")
def group_avg_median(spark, d):
    return A.group_mean_median(load(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", PLACES)


@query("group_count_avg", """
SELECT l_suppkey, count(l_orderkey) AS count_l_orderkey, round(avg(l_quantity), 6) AS avg_l_quantity FROM lineitem GROUP BY 1""")
def group_count_avg(spark, d):
    grouped = A.group_by_map(load(spark, d, "lineitem"), ["l_suppkey"], {"l_orderkey": "count", "l_quantity": "avg"})
    return grouped.withColumn("avg_l_quantity", F.round("avg_l_quantity", 6))


@query("rank_groups_count", """
SELECT o_orderpriority, count(o_totalprice) AS flight_count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1""")
def rank_groups_count(spark, d):
    return A.ranked_groups(load(spark, d, "orders"), "o_orderpriority", F.count("o_totalprice"), "flight_count")


@query("rank_groups_sum", """
SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(24,4))) AS DOUBLE) AS total FROM orders GROUP BY 1""")
def rank_groups_sum(spark, d):
    return A.ranked_groups(load(spark, d, "orders"), "o_custkey", A.sum_of(F.col("o_totalprice"), PLACES), "total")


@query("rank_groups_avg", f"""
SELECT CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS weekday, {mean_sql('o_totalprice')} AS mean_price
FROM orders GROUP BY 1 ORDER BY 2 DESC, 1""")
def rank_groups_avg(spark, d):
    rows = load(spark, d, "orders").withColumn("weekday", F.dayofweek("o_orderdate"))
    return A.ranked_groups(rows, "weekday", A.mean_of(F.col("o_totalprice"), PLACES), "mean_price")


@query("group_stats", f"""
SELECT l_partkey, l_suppkey, {mean_sql('l_extendedprice')} AS mean, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def group_stats(spark, d):
    return A.group_stats(load(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_extendedprice", PLACES)


@query("describe_column", """
WITH s AS (SELECT count(l_extendedprice)::DOUBLE AS count, round(avg(l_extendedprice), 4) AS mean,
  round(stddev_samp(l_extendedprice), 4) AS stddev, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem)
SELECT statistic, value FROM (UNPIVOT s ON COLUMNS(*) INTO NAME statistic VALUE value)""")
def describe_column(spark, d):
    described = A.describe_column(load(spark, d, "lineitem"), "l_extendedprice")
    return described.withColumn("value", F.round("value", 4))


@query("quantile_exact", "SELECT quantile_cont(l_extendedprice, 0.99) AS quantile FROM lineitem")
def quantile_exact(spark, d):
    return A.quantile(load(spark, d, "lineitem"), "l_extendedprice", 0.99)


@query("quantile_approx", "SELECT count(l_extendedprice) AS n, true AS is_value, true AS in_error FROM lineitem")
def quantile_approx(spark, d):
    """The approximate quantile is a value of the column whose rank is off by a hundredth of the rows at most."""
    rows = load(spark, d, "lineitem").select("l_extendedprice")
    found = A.quantile(rows, "l_extendedprice", 0.99, accuracy=100)
    v, q = F.col("l_extendedprice"), F.col("quantile")
    counts = rows.crossJoin(F.broadcast(found)).agg(F.count(v).alias("n"), F.count_if(v < q).alias("below"), F.count_if(v <= q).alias("upto"))
    in_error = (F.col("upto") >= 0.98 * F.col("n")) & (F.col("below") <= F.col("n"))
    return counts.select("n", (F.col("upto") > F.col("below")).alias("is_value"), in_error.alias("in_error"))


@query("histogram", """
SELECT CAST(least(floor((l_extendedprice - 5000) * 50 / 40000), 49) AS INTEGER) AS bin, count(*) AS n
FROM lineitem WHERE l_extendedprice BETWEEN 5000 AND 45000 GROUP BY 1""")
def histogram(spark, d):
    return A.histogram(load(spark, d, "lineitem"), "l_extendedprice", 50, 5000, 45000)


@query("histogram_span", """
WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT CAST(least(floor((value - lo) * 20 / (hi - lo)), 19) AS INTEGER) AS bin, count(*) AS n FROM events, s GROUP BY 1""")
def histogram_span(spark, d):
    return A.histogram(load(spark, d, "events"), "value", 20)


@query("stats_overview", f"""
WITH r AS (SELECT p_size % 5 + 1 AS rating, p_retailprice FROM part),
c AS (SELECT rating, count(*) AS n FROM r GROUP BY 1)
SELECT CAST((SELECT count(*) FROM r) AS BIGINT) AS total,
  (SELECT 'R$ ' || CAST(round({mean_sql('p_retailprice')}, 2) AS VARCHAR) FROM r) AS mean_price,
  (SELECT '{{' || string_agg('"' || rating || '":' || n, ',' ORDER BY rating) || '}}' FROM c) AS rating_distribution""")
def stats_overview(spark, d):
    return A.overview(load(spark, d, "part").withColumn("rating", F.col("p_size") % 5 + 1), "p_retailprice", "rating", PLACES)


@query("stats_categories", f"""
SELECT p_brand, count(*) AS n, round({mean_sql('p_retailprice')}, 2) AS mean_price FROM part GROUP BY 1""")
def stats_categories(spark, d):
    return A.category_stats(load(spark, d, "part"), "p_brand", "p_retailprice", PLACES)


@query("duplicate_count", """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def duplicate_count(spark, d):
    return A.duplicate_rows(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("unknown_profile", """
WITH e AS (SELECT CASE WHEN event_type IN ('error', 'signup') THEN 'unknown' ELSE event_type END AS event_type,
  CASE WHEN event_id % 9 = 0 THEN 'unknown' ELSE 'mobile' END AS contact, props FROM events)
SELECT column_name, hits FROM (
  SELECT 'event_type' AS column_name, count(*) FILTER (event_type = 'unknown') AS hits FROM e
  UNION ALL SELECT 'contact', count(*) FILTER (contact = 'unknown') FROM e
  UNION ALL SELECT 'props', count(*) FILTER (props = 'unknown') FROM e) WHERE hits > 0""")
def unknown_profile(spark, d):
    kind = F.col("event_type")
    events = load(spark, d, "events").select(
        F.when(kind.isin("error", "signup"), "unknown").otherwise(kind).alias("event_type"),
        F.when(F.col("event_id") % 9 == 0, "unknown").otherwise("mobile").alias("contact"),
        "props", "value",
    )
    return A.literal_profile(events)


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def value_counts(spark, d):
    return A.value_counts(load(spark, d, "events"), "event_type")


@query("group_rate", """
SELECT CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday, round(count(*) FILTER (event_type = 'purchase') / count(*), 3) AS rate
FROM events GROUP BY 1""")
def group_rate(spark, d):
    events = load(spark, d, "events").withColumn("weekday", F.dayofweek("ts"))
    return A.group_rate(events, "weekday", F.col("event_type") == "purchase")


@query("conditional_mean", """
SELECT CAST(sum(CAST(value AS DECIMAL(24,4))) FILTER (event_type = 'purchase') AS DOUBLE) / count(*) FILTER (event_type = 'purchase') AS conditional_mean,
  count(*) FILTER (event_type = 'purchase') / count(*) AS rate FROM events""")
def conditional_mean(spark, d):
    return A.conditional_mean(load(spark, d, "events"), "value", F.col("event_type") == "purchase", PLACES)


@query("relative_error", """
WITH e AS (SELECT (round(l_extendedprice, -2) - l_extendedprice) * 100 / nullif(l_extendedprice, 0) AS e FROM lineitem)
SELECT round(min(e), 6) AS min_error, round(max(e), 6) AS max_error, round(avg(e), 6) AS mean_error,
  round(stddev_pop(e), 6) AS std_error FROM e""")
def relative_error(spark, d):
    price = F.col("l_extendedprice")
    return A.relative_error(load(spark, d, "lineitem"), F.round(price, -2), price)


@query("segment_fairness", f"""
WITH {LOGS}, per AS (SELECT segment, count(arm) AS exposure, round(sum(reward) / count(reward), 4) AS conversion
  FROM offer_log GROUP BY 1)
SELECT segment, exposure, conversion, round(exposure / sum(exposure) OVER (), 4) AS exposure_share,
  round(max(conversion) OVER () - min(conversion) OVER (), 4) AS conversion_gap FROM per""")
def segment_fairness(spark, d):
    return A.segment_fairness(offer_log(spark, d), "segment", "arm", "reward")


@query("map_aggregate", """
SELECT '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS counts
FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def map_aggregate(spark, d):
    return A.map_of_counts(load(spark, d, "events"), "event_type").select(F.to_json("counts").alias("counts"))
