"""Queries of the series and window operators."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tidewell.operators import windows as W
from tidewell.operators.forecast import series_trend
from tidewell.plans.common import BARS, PLACES, bars
from tidewell.plans.registry import query
from tidewell.plans.relational import LINE_KEY, LINE_KEY_SQL
from tidewell.tables import load


@query("daily_ohlcv", f"WITH {BARS} SELECT * FROM bars")
def daily_ohlcv(spark, d):
    return bars(spark, d)


@query("expanding_mean", f"""
WITH {BARS} SELECT series, day, close,
  round(CAST(sum(CAST(close AS DECIMAL(24,4))) OVER w AS DOUBLE) / count(close) OVER w, 2) AS moving_mean
FROM bars WINDOW w AS (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING)""")
def expanding_mean(spark, d):
    return W.expanding_mean(bars(spark, d).select("series", "day", "close"), "series", "day", "close", "moving_mean", decimals=PLACES)


@query("impute_partition_mean", f"""
WITH t AS (SELECT {LINE_KEY_SQL}, CASE WHEN l_orderkey % 6 <> 0 THEN l_tax END AS l_tax FROM lineitem)
SELECT {LINE_KEY_SQL}, coalesce(l_tax, CAST(sum(CAST(l_tax AS DECIMAL(24,4))) OVER w AS DOUBLE) / count(l_tax) OVER w) AS l_tax FROM t
WINDOW w AS (PARTITION BY l_suppkey)""")
def impute_partition_mean(spark, d):
    tax = F.when(F.col("l_orderkey") % 6 != 0, F.col("l_tax")).alias("l_tax")
    rows = load(spark, d, "lineitem").select(*LINE_KEY, tax)
    return W.fill_with_group_mean(rows, "l_suppkey", "l_tax", PLACES)


LAGS = ", ".join(f"lag({c}, {i}) OVER w AS {c}_lag{i}" for i in range(5, 0, -1) for c in ("close", "volume"))


@query("lag_matrix", f"""
WITH {BARS} SELECT series, day, close, volume, {LAGS} FROM bars
WINDOW w AS (PARTITION BY series ORDER BY day) QUALIFY row_number() OVER w > 5""")
def lag_matrix(spark, d):
    narrow = bars(spark, d).select("series", "day", "close", "volume")
    return W.lag_matrix(narrow, "series", "day", ["close", "volume"], 5)


LEADS = ", ".join(f"lead(close, {j}) OVER w AS close_lead{j}" for j in range(1, 4))


@query("lead_targets", f"""
WITH {BARS} SELECT series, day, close, {LEADS} FROM bars
WINDOW w AS (PARTITION BY series ORDER BY day) QUALIFY lead(true, 3) OVER w""")
def lead_targets(spark, d):
    return W.lead_targets(bars(spark, d).select("series", "day", "close"), "series", "day", "close", 3)


@query("lag_of_ticks", """
SELECT user_id, event_id, value, lag(value, 2) OVER w AS value_lag2, lag(value, 1) OVER w AS value_lag1 FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY row_number() OVER w > 2""")
def lag_of_ticks(spark, d):
    """Lags of raw rows: users of any size, cut into overlapping blocks."""
    rows = load(spark, d, "events").select("user_id", "event_id", "value")
    return W.lag_matrix(rows, "user_id", "event_id", ["value"], 2, block_rows=64)


@query("change_flag", """
WITH w AS (SELECT CAST(floor(date_sub('day', (SELECT min(ts) FROM events), ts) / 7) AS BIGINT) AS week,
    count(*) FILTER (event_type = 'purchase') / count(*) AS rate FROM events GROUP BY 1),
p AS (SELECT *, lag(rate) OVER (ORDER BY week) AS previous FROM w)
SELECT week, round(rate, 6) AS rate, round(previous, 6) AS previous, round(abs(rate - previous), 6) AS delta,
  coalesce(abs(rate - previous) > 0.01, false) AS changed FROM p""")
def change_flag(spark, d):
    from tidewell.functions.columns import window_number

    events = load(spark, d, "events")
    first = events.agg(F.min("ts").alias("first"))
    weekly = (
        events.crossJoin(F.broadcast(first))
        .groupBy(window_number(F.col("ts"), F.col("first"), 7).alias("week"))
        .agg((F.count_if(F.col("event_type") == "purchase") / F.count("*")).alias("rate"))
    )
    flagged = W.change_flag(weekly, "week", "rate", 0.01)
    return flagged.withColumns({c: F.round(c, 6) for c in ("rate", "previous", "delta")})


@query("running_sum", """
SELECT user_id, event_id, ts, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total
FROM events""")
def running_sum(spark, d):
    rows = load(spark, d, "events").select("user_id", "event_id", "ts", "value")
    summed = W.running_total(rows, ["user_id"], ["ts", "event_id"], F.col("value").cast("decimal(18,2)"), "total")
    return summed.withColumn("total", F.col("total").cast("double")).drop("value")


@query("running_count", """
SELECT user_id, event_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS calls
FROM events""")
def running_count(spark, d):
    rows = load(spark, d, "events").select("user_id", "event_id", "ts")
    return W.running_count(rows, ["user_id"], ["ts", "event_id"], "calls")


@query("carry_forward", f"""
WITH {BARS}, span AS (SELECT series, min(day) AS a, max(day) AS b FROM bars GROUP BY series),
days AS (SELECT series, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
gaps AS (SELECT series, day, CASE WHEN dayofyear(day) % 3 <> 0 THEN close END AS close FROM days LEFT JOIN bars USING (series, day))
SELECT series, day, last_value(close IGNORE NULLS) OVER (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING) AS close FROM gaps""")
def carry_forward(spark, d):
    full = W.every_day(bars(spark, d).select("series", "day", "close"), "series", "day")
    gaps = full.withColumn("close", F.when(F.dayofyear("day") % 3 != 0, F.col("close")))
    return W.carry_forward(gaps, "series", "day", "close")


@query("lookback_pad", f"""
WITH {BARS}, kept AS (SELECT series, day, close, volume FROM bars WHERE day <= DATE '2024-01-08'
  QUALIFY row_number() OVER (PARTITION BY series ORDER BY day DESC) <= 10),
l AS (SELECT series, list(close ORDER BY day) AS c, list(volume ORDER BY day) AS v FROM kept GROUP BY 1)
SELECT series, c || list_transform(range(10 - len(c)), lambda x: c[-1]) AS close,
  v || list_transform(range(10 - len(v)), lambda x: v[-1]) AS volume FROM l""")
def lookback_pad(spark, d):
    return W.look_back(bars(spark, d), "series", "day", ["close", "volume"], date(2024, 1, 8), 10)


@query("chrono_split", """
WITH p AS (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, event_id, ts, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.9::DOUBLE) THEN 'test' ELSE 'validation' END AS part FROM p""")
def chrono_split(spark, d):
    rows = load(spark, d, "events").select("event_type", "event_id", "ts")
    shares = [("train", 0.8), ("test", 0.1), ("validation", 0.1)]
    return W.chronological_split(rows, ["event_type"], ["ts", "event_id"], shares)


@query("series_trend", f"""
WITH {BARS} SELECT series, count(*) AS n, round(regr_slope(close, date_diff('day', DATE '1970-01-01', day)), 6) AS slope
FROM bars GROUP BY 1""")
def trend(spark, d):
    return series_trend(bars(spark, d), "series", "day", "close").withColumn("slope", F.round("slope", 6))


TICKS = "w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


def _ticks(spark, d):
    return load(spark, d, "events").select("event_id", "event_type", "ts", "value")


@query("tick_running_mean", f"""
SELECT event_id, CAST(sum(CAST(value AS DECIMAL(24, {PLACES}))) OVER w AS DOUBLE) / count(value) OVER w AS running_mean FROM events WINDOW {TICKS}""")
def tick_running_mean(spark, d):
    """Running mean of raw ticks: a few series that hold all rows, so each spreads over ranges."""
    out = W.expanding_mean(_ticks(spark, d), "event_type", "ts", "value", "running_mean", digits=None, decimals=PLACES, ranges=True, tie="event_id")
    return out.select("event_id", "running_mean")


@query("tick_carry_forward", f"""
SELECT event_id, last_value(v IGNORE NULLS) OVER w AS value FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN value END AS v FROM events) WINDOW {TICKS}""")
def tick_carry_forward(spark, d):
    gaps = _ticks(spark, d).withColumn("value", F.when(F.col("event_id") % 5 == 0, F.col("value")))
    return W.carry_forward(gaps, "event_type", "ts", "value", ranges=True, tie="event_id").select("event_id", "value")


@query("tick_look_back", """
SELECT event_type, list(value ORDER BY ts, event_id) AS value FROM (SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-20'
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 20) GROUP BY 1""")
def tick_look_back(spark, d):
    """The last twenty ticks of every series up to a moment."""
    moment = F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz")
    return W.look_back(_ticks(spark, d), "event_type", "ts", ["value"], moment, 20, ranges=True, tie="event_id")
