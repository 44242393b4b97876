"""Queries of the scalar functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import columns as C
from tidewell.operators.aggregates import mean_of
from tidewell.operators.joins import with_group_stats
from tidewell.operators.windows import every_day, expanding_mean, fill_with_group_floor, fill_with_group_int
from tidewell.plans.common import BARS, CLIENTS, FLIGHTS, PLACES, bars, clients, flights
from tidewell.plans.registry import query
from tidewell.tables import load


@query("date_key", """
SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS dataproc FROM orders""")
def date_key(spark, d):
    return load(spark, d, "orders").select("o_orderkey", C.date_key(F.col("o_orderdate")).alias("dataproc"))


@query("to_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_day FROM orders")
def to_date(spark, d):
    return load(spark, d, "orders").select("o_orderkey", C.plain_date(F.col("o_orderdate")).alias("order_day"))


@query("candle_features", f"""
WITH {BARS}
SELECT series, day, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS dataproc, open, high, low, close, volume,
  round(close - open, 4) AS candle_body,
  round(high - CASE WHEN close - open >= 0 THEN close ELSE open END, 4) AS upper_shadow,
  round(low - CASE WHEN close - open >= 0 THEN open ELSE close END, 4) AS lower_shadow,
  round(CAST(sum(CAST(close AS DECIMAL(24,4))) OVER w AS DOUBLE) / count(close) OVER w, 2) AS moving_mean
FROM bars WINDOW w AS (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING)""")
def candle_features(spark, d):
    candles = C.candle_columns("open", "high", "low", "close")
    rounded = {name: F.round(expr, 4) for name, expr in candles.items()}
    full = expanding_mean(bars(spark, d).withColumns(rounded), "series", "day", "close", "moving_mean", decimals=PLACES)
    return full.withColumn("dataproc", C.date_key(F.col("day")))


@query("impute_group_floor", """
WITH t AS (SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
    CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END AS l_quantity FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
  coalesce(l_quantity, floor(avg(l_quantity) OVER (PARTITION BY l_suppkey))) AS l_quantity FROM t""")
def impute_group_floor(spark, d):
    rows = load(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity")).alias("l_quantity"),
    )
    return fill_with_group_floor(rows, "l_suppkey", "l_quantity", PLACES)


@query("impute_group_int", """
WITH t AS (SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
    CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_quantity END AS l_quantity FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
  CAST(trunc(coalesce(l_quantity, avg(l_quantity) OVER (PARTITION BY l_partkey))) AS INTEGER) AS l_quantity FROM t""")
def impute_group_int(spark, d):
    rows = load(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        F.when(F.col("l_orderkey") % 4 != 0, F.col("l_quantity")).alias("l_quantity"),
    )
    return fill_with_group_int(rows, "l_partkey", "l_quantity", PLACES)


DEPARTED = FLIGHTS + """,
departed AS (
  SELECT * REPLACE (CASE WHEN departure IS NULL AND wheels_off IS NULL THEN 0
                         WHEN departure IS NULL THEN wheels_off - taxi_out ELSE departure END AS departure)
  FROM flights)"""


def _departed(spark, d):
    fixed = C.departure_time(F.col("departure"), F.col("wheels_off"), F.col("taxi_out"))
    return flights(spark, d).withColumn("departure", fixed)


@query("repair_departure", f"WITH {DEPARTED} SELECT flight, departure, taxi_out, wheels_off FROM departed")
def repair_departure(spark, d):
    return _departed(spark, d).select("flight", "departure", "taxi_out", "wheels_off")


LIFTED = DEPARTED + """,
lifted AS (
  SELECT * REPLACE (CASE WHEN coalesce(wheels_off, departure + taxi_out) > 2360
                         THEN 2360 - (departure + taxi_out)
                         ELSE coalesce(wheels_off, departure + taxi_out) END AS wheels_off)
  FROM departed)"""


def _lifted(spark, d):
    fixed = C.wheels_off_time(F.col("wheels_off"), F.col("departure"), F.col("taxi_out"))
    return _departed(spark, d).withColumn("wheels_off", fixed)


@query("repair_wheels_off", f"WITH {LIFTED} SELECT flight, departure, taxi_out, wheels_off FROM lifted")
def repair_wheels_off(spark, d):
    return _lifted(spark, d).select("flight", "departure", "taxi_out", "wheels_off")


LANDED = LIFTED + """,
arrived AS (
  SELECT * REPLACE (CASE WHEN arrival IS NULL AND wheels_on IS NULL THEN 0
                         WHEN arrival IS NULL THEN wheels_on + taxi_in ELSE arrival END AS arrival)
  FROM lifted),
landed AS (
  SELECT * REPLACE (CASE WHEN coalesce(wheels_on, arrival - taxi_in) < 0 THEN 0 - (arrival - taxi_in)
                         ELSE coalesce(wheels_on, arrival - taxi_in) END AS wheels_on)
  FROM arrived)"""


def _landed(spark, d):
    arrival = C.arrival_time(F.col("arrival"), F.col("wheels_on"), F.col("taxi_in"))
    arrived = _lifted(spark, d).withColumn("arrival", arrival)
    return arrived.withColumn(
        "wheels_on", C.wheels_on_time(F.col("wheels_on"), F.col("arrival"), F.col("taxi_in"))
    )


@query("repair_arrival", f"WITH {LANDED} SELECT flight, arrival, taxi_in, wheels_on FROM landed")
def repair_arrival(spark, d):
    return _landed(spark, d).select("flight", "arrival", "taxi_in", "wheels_on")


@query("overnight_diff", f"""
WITH {LANDED}, g AS (
  SELECT flight, wheels_on - wheels_off AS air, arrival - departure AS elapsed,
    (arrival // 100) * 60 + arrival % 100 - ((departure // 100) * 60 + departure % 100) AS minutes
  FROM landed)
SELECT flight, CASE WHEN air >= 0 THEN air ELSE air + 2400 END AS air_time,
  CASE WHEN elapsed >= 0 THEN elapsed ELSE elapsed + 2400 END AS elapsed_time,
  CASE WHEN minutes >= 0 THEN minutes ELSE minutes + 1440 END AS elapsed_minutes
FROM g""")
def overnight_diff(spark, d):
    return _landed(spark, d).select(
        "flight",
        C.overnight_difference(F.col("wheels_off"), F.col("wheels_on")).alias("air_time"),
        C.overnight_difference(F.col("departure"), F.col("arrival")).alias("elapsed_time"),
        C.overnight_difference(F.col("departure"), F.col("arrival"), minutes=True).alias("elapsed_minutes"),
    )


@query("fill_from_column", f"""
WITH {LANDED}
SELECT flight, coalesce(scheduled, CASE WHEN arrival - departure >= 0 THEN arrival - departure
  ELSE arrival - departure + 2400 END) AS scheduled FROM landed""")
def fill_from_column(spark, d):
    elapsed = C.overnight_difference(F.col("departure"), F.col("arrival"))
    return _landed(spark, d).select("flight", F.coalesce(F.col("scheduled"), elapsed).alias("scheduled"))


RATING_TEXT_SQL = """CASE p_size % 7 WHEN 0 THEN 'star-rating One' WHEN 1 THEN 'star-rating Two'
  WHEN 2 THEN 'star-rating Three' WHEN 3 THEN 'star-rating Four' WHEN 4 THEN 'star-rating Five'
  WHEN 5 THEN 'One or Five' ELSE 'none' END"""


def _rating_text():
    words = ["star-rating One", "star-rating Two", "star-rating Three", "star-rating Four", "star-rating Five", "One or Five", "none"]
    return F.element_at(F.array(*(F.lit(w) for w in words)), F.col("p_size") % 7 + 1)


RATING_CASE_SQL = """CASE WHEN contains(t, 'One') THEN 1 WHEN contains(t, 'Two') THEN 2
  WHEN contains(t, 'Three') THEN 3 WHEN contains(t, 'Four') THEN 4 WHEN contains(t, 'Five') THEN 5 END"""


@query("rating_words", f"""
SELECT p_partkey, t AS rating_text, {RATING_CASE_SQL} AS rating
FROM (SELECT p_partkey, {RATING_TEXT_SQL} AS t FROM part)""")
def rating_words(spark, d):
    worded = load(spark, d, "part").select("p_partkey", _rating_text().alias("rating_text"))
    return worded.withColumn("rating", C.rating_from_words(F.col("rating_text")))


@query("contains_flag", "SELECT p_partkey, CAST(contains(p_name, 'ring') AS INTEGER) AS has_piece FROM part")
def contains_flag(spark, d):
    return load(spark, d, "part").select("p_partkey", C.contains_flag(F.col("p_name"), "ring").alias("has_piece"))


@query("try_number", """
SELECT event_id, try_cast(CASE WHEN event_type = 'error' THEN event_type || '!' ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS number
FROM events""")
def try_number(spark, d):
    text = F.when(F.col("event_type") == "error", F.concat("event_type", F.lit("!"))).otherwise(
        F.get_json_object("props", "$.k")
    )
    return load(spark, d, "events").select("event_id", C.number_or_null(text).alias("number"))


@query("text_pieces", r"""
SELECT o_orderkey, substr(o_orderpriority, 3) AS after_prefix,
  list_extract(string_split(o_orderpriority, '-'), -1) AS last_piece,
  TRY_CAST(list_extract(string_split_regex(trim('Page ' || o_custkey || ' of ' || o_orderkey), '\s+'), -1) AS INTEGER) AS last_word
FROM orders""")
def text_pieces(spark, d):
    pager = F.concat_ws(" ", F.lit("Page"), F.col("o_custkey"), F.lit("of"), F.col("o_orderkey"))
    return load(spark, d, "orders").select(
        "o_orderkey",
        C.after_prefix(F.col("o_orderpriority"), 2).alias("after_prefix"),
        C.last_piece(F.col("o_orderpriority")).alias("last_piece"),
        C.last_word_int(pager).alias("last_word"),
    )


@query("resolve_url", r"""
WITH links AS (
  SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS href FROM pages),
forms AS (
  SELECT page_id, url, unnest([href, substr(href, 2), '../..' || href, 'https://other.example' || href]) AS href FROM links),
parts AS (
  SELECT page_id, href, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root,
    CASE WHEN regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', ''), '[^/]*$', '') = '' THEN '/'
      ELSE regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', ''), '[^/]*$', '') END AS folder
  FROM forms)
SELECT page_id, href, CASE WHEN href LIKE 'https://%' THEN href WHEN href LIKE '/%' THEN root || href
  WHEN href LIKE '../../%' THEN root || '/' ||
     array_to_string(list_slice(string_split(substr(folder, 2), '/'), 1, greatest(len(string_split(substr(folder, 2), '/')) - 3, 0)) || [substr(href, 7)], '/')
  ELSE root || folder || href END AS link
FROM parts""")
def resolve_url(spark, d):
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1))
    links = load(spark, d, "pages").select("page_id", "url", F.explode(found).alias("href"))
    forms = F.array(
        F.col("href"), F.substr("href", F.lit(2)), F.concat(F.lit("../.."), "href"),
        F.concat(F.lit("https://other.example"), "href"),
    )
    return links.select("page_id", "url", F.explode(forms).alias("href")).select(
        "page_id", "href", C.resolve_link(F.col("url"), F.col("href")).alias("link")
    )


@query("age_bins", """
SELECT p_partkey, CASE WHEN v > 17 AND v <= 25 THEN '18-25' WHEN v > 25 AND v <= 35 THEN '26-35'
  WHEN v > 35 AND v <= 45 THEN '36-45' WHEN v > 45 AND v <= 55 THEN '46-55' WHEN v > 55 AND v <= 65 THEN '56-65'
  WHEN v > 65 AND v <= 90 THEN '66+' END AS age_group
FROM (SELECT p_partkey, p_size * 2 AS v FROM part)""")
def age_bins(spark, d):
    return load(spark, d, "part").select(
        "p_partkey", C.right_closed_bins(F.col("p_size") * 2, C.AGE_BINS).alias("age_group")
    )


@query("sentinel_flag", """
SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate, l_extendedprice, CAST(p <> -1 AS INTEGER) AS contacted_before,
  greatest(p, 0) AS pdays_clean
FROM (SELECT *, l_orderkey % 9 - 1 AS p FROM lineitem)""")
def sentinel_flag(spark, d):
    shifted = F.col("l_orderkey") % 9 - 1
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        C.contacted_flag(shifted).alias("contacted_before"), C.cleaned_days(shifted).alias("pdays_clean"),
    )


@query("clip_values", """
SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
  greatest(0.02::DOUBLE, least(0.07::DOUBLE, l_discount)) AS clipped FROM lineitem""")
def clip_values(spark, d):
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        C.clip(F.col("l_discount"), 0.02, 0.07).alias("clipped"),
    )


@query("assign_segment", f"WITH {CLIENTS} SELECT client, job, poutcome, pdays, housing, loan, segment FROM clients")
def assign_segment(spark, d):
    return clients(spark, d).select("client", "job", "poutcome", "pdays", "housing", "loan", "segment")


@query("date_windows", """
WITH e AS (SELECT event_id, ts, min(ts) OVER () AS first FROM events)
SELECT event_id, ts + to_days(CAST(event_id % 40 AS INTEGER)) AS due,
  CAST(floor(date_sub('day', first, ts) / 7) AS BIGINT) AS week
FROM e""")
def date_windows(spark, d):
    events = load(spark, d, "events")
    first = events.agg(F.min("ts").alias("first"))
    return events.crossJoin(F.broadcast(first)).select(
        "event_id",
        C.plus_days(F.col("ts"), F.col("event_id") % 40).alias("due"),
        C.window_number(F.col("ts"), F.col("first"), 7).alias("week"),
    )


@query("future_days", f"""
WITH {BARS}, last AS (SELECT series, max(day) AS m FROM bars GROUP BY series)
SELECT series, CAST(unnest(generate_series(m + 1, m + 10, INTERVAL 1 DAY)) AS DATE) AS day FROM last""")
def future_days(spark, d):
    last = bars(spark, d).groupBy("series").agg(F.max("day").alias("m"))
    ahead = F.sequence(F.date_add("m", 1), F.date_add("m", 10), F.expr("interval 1 day"))
    return last.select("series", F.explode(ahead).alias("day"))


@query("json_fields", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.absent') AS absent,
  '{"id":' || event_id || ',"type":"' || event_type || '"}' AS packed
FROM events""")
def json_fields(spark, d):
    parsed = C.json_fields(F.col("props"), {"k": T.LongType(), "absent": T.StringType()})
    packed = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    rows = load(spark, d, "events").select("event_id", parsed.alias("p"), packed.alias("packed"))
    return rows.select("event_id", "p.k", "p.absent", "packed")


@query("format_numbers", """
SELECT p_partkey, round(p_retailprice / 7, 4) AS rounded, round(p_retailprice / 7 * 100, 2) AS percent,
  'R$ ' || CAST(round(p_retailprice, 2) AS VARCHAR) AS price_text FROM part""")
def format_numbers(spark, d):
    seventh = F.col("p_retailprice") / 7
    return load(spark, d, "part").select(
        "p_partkey", F.round(seventh, 4).alias("rounded"), F.round(seventh * 100, 2).alias("percent"),
        C.reais(F.col("p_retailprice")).alias("price_text"),
    )


@query("stamp_records", """
SELECT event_id, md5(concat_ws('|', CAST(event_id AS VARCHAR), event_type, 'record')) AS record_id, true AS stamped
FROM events""")
def stamp_records(spark, d):
    return load(spark, d, "events").select(
        "event_id",
        C.record_id(F.col("event_id"), F.col("event_type")).alias("record_id"),
        F.current_timestamp().isNotNull().alias("stamped"),
    )


@query("unknown_code", """
SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 ELSE 0 END AS code FROM events""")
def unknown_code(spark, d):
    codes = {"click": 1, "purchase": 2, "view": 3}
    return load(spark, d, "events").select("event_id", C.known_code(F.col("event_type"), codes).alias("code"))


@query("threshold_status", """
WITH r AS (SELECT p_partkey, abs(p_retailprice / (CAST(sum(CAST(p_retailprice AS DECIMAL(24,4))) OVER (PARTITION BY p_brand) AS DOUBLE)
    / count(*) OVER (PARTITION BY p_brand)) - 1) AS score FROM part)
SELECT p_partkey, round(score, 6) AS score,
  CASE WHEN score < 0.1 THEN 'stable' WHEN score < 0.2 THEN 'monitor' ELSE 'retrain' END AS status FROM r""")
def threshold_status(spark, d):
    part = with_group_stats(load(spark, d, "part"), ["p_brand"], {"mean": mean_of(F.col("p_retailprice"), PLACES)})
    score = F.abs(F.col("p_retailprice") / F.col("mean") - 1)
    return part.select("p_partkey", F.round(score, 6).alias("score"), C.drift_status(score).alias("status"))


@query("udf_equivalence", f"""
SELECT p_partkey, {RATING_CASE_SQL} AS by_expression, {RATING_CASE_SQL} AS by_function
FROM (SELECT p_partkey, {RATING_TEXT_SQL} AS t FROM part)""")
def udf_equivalence(spark, d):
    words = C.RATING_WORDS

    @F.pandas_udf("int")
    def rate(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: next((n for w, n in words.items() if w in t), None)).astype("Int32")

    worded = load(spark, d, "part").select("p_partkey", _rating_text().alias("t"))
    return worded.select("p_partkey", C.rating_from_words(F.col("t")).alias("by_expression"), rate("t").alias("by_function"))


@query("calendar_gaps", f"""
WITH {BARS}, kept AS (SELECT * FROM bars WHERE dayofweek(day) NOT IN (0, 6)),
span AS (SELECT series, min(day) AS a, max(day) AS b FROM kept GROUP BY series),
days AS (SELECT series, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span)
SELECT series, day, close FROM days LEFT JOIN kept USING (series, day)""")
def calendar_gaps(spark, d):
    kept = bars(spark, d).where(~F.dayofweek("day").isin(1, 7)).select("series", "day", "close")
    return every_day(kept, "series", "day")
