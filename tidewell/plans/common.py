"""Inputs shared by several queries, each with the SQL that derives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.columns import SEGMENTS, client_segment
from tidewell.operators.joins import join_outcomes
from tidewell.operators.offers import ARMS
from tidewell.operators.windows import daily_bars
from tidewell.tables import load


# The money and share columns of the tables hold at most four decimal places, so sums in
# fixed point are exact and equal to those of the SQL.
PLACES = 4


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


# --- daily bars of the event values, one series per event type ---


def bars(spark: SparkSession, folder: str) -> DataFrame:
    return daily_bars(load(spark, folder, "events"), "event_type", "ts", "value", "event_id")


BARS = """
bars AS (
  SELECT event_type AS series, CAST(ts AS DATE) AS day,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, count(value) AS volume
  FROM events GROUP BY 1, 2)"""


# --- clock columns with planted gaps, one row per order ---


def flights(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    departs = (k * 37 % 24) * 100 + k * 13 % 60
    arrives = ((k * 37 + 5) % 24) * 100 + k * 29 % 60
    taxi_out, taxi_in = k % 40 + 5, k % 15 + 2
    return load(spark, folder, "orders").select(
        k.alias("flight"),
        F.when(k % 11 != 0, departs).cast("int").alias("departure"),
        taxi_out.cast("int").alias("taxi_out"),
        F.when(k % 7 != 0, departs + taxi_out).cast("int").alias("wheels_off"),
        F.when(k % 9 != 0, arrives - taxi_in).cast("int").alias("wheels_on"),
        taxi_in.cast("int").alias("taxi_in"),
        F.when(k % 13 != 0, arrives).cast("int").alias("arrival"),
        F.when(k % 5 != 0, k % 300 + 20).cast("int").alias("scheduled"),
    )


FLIGHTS = """
flights AS (
  SELECT o_orderkey AS flight,
    CAST(CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey * 37 % 24) * 100 + o_orderkey * 13 % 60 END AS INTEGER) AS departure,
    CAST(o_orderkey % 40 + 5 AS INTEGER) AS taxi_out,
    CAST(CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey * 37 % 24) * 100 + o_orderkey * 13 % 60 + o_orderkey % 40 + 5 END AS INTEGER) AS wheels_off,
    CAST(CASE WHEN o_orderkey % 9 <> 0 THEN ((o_orderkey * 37 + 5) % 24) * 100 + o_orderkey * 29 % 60 - (o_orderkey % 15 + 2) END AS INTEGER) AS wheels_on,
    CAST(o_orderkey % 15 + 2 AS INTEGER) AS taxi_in,
    CAST(CASE WHEN o_orderkey % 13 <> 0 THEN ((o_orderkey * 37 + 5) % 24) * 100 + o_orderkey * 29 % 60 END AS INTEGER) AS arrival,
    CAST(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 300 + 20 END AS INTEGER) AS scheduled
  FROM orders)"""


# --- clients: customers with derived attributes and their segment ---

JOBS = ["student", "retired", "admin.", "services", "technician", "management", "blue-collar"]
PRIOR = ["success", "failure", "nonexistent", "unknown"]


def clients(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    made = load(spark, folder, "customer").select(
        k.alias("client"),
        (k % 70 + 18).cast("int").alias("age"),
        pick(JOBS, k % 7).alias("job"),
        pick(PRIOR, F.floor(k / 5) % 4).alias("poutcome"),
        F.when(k % 3 == 0, -1).otherwise(k % 30).cast("int").alias("pdays"),
        F.when(k % 2 == 0, "yes").otherwise("no").alias("housing"),
        F.when(k % 11 < 6, "yes").otherwise("no").alias("loan"),
        F.col("c_acctbal").alias("balance"),
    )
    rule = client_segment(
        F.col("poutcome"), F.col("pdays"), F.col("job"), F.col("housing"), F.col("loan")
    )
    return made.withColumn("segment", rule)


CLIENTS = f"""
made AS (
  SELECT c_custkey AS client, CAST(c_custkey % 70 + 18 AS INTEGER) AS age,
    {sql_list(JOBS)}[c_custkey % 7 + 1] AS job,
    {sql_list(PRIOR)}[(c_custkey // 5) % 4 + 1] AS poutcome,
    CAST(CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE c_custkey % 30 END AS INTEGER) AS pdays,
    CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS housing,
    CASE WHEN c_custkey % 11 < 6 THEN 'yes' ELSE 'no' END AS loan,
    c_acctbal AS balance
  FROM customer),
clients AS (
  SELECT *, CASE WHEN poutcome = 'success' THEN '{SEGMENTS[0]}'
    WHEN pdays <> -1 AND poutcome = 'failure' THEN '{SEGMENTS[1]}'
    WHEN job IN ('student', 'retired') THEN '{SEGMENTS[2]}'
    WHEN housing = 'yes' AND loan = 'yes' THEN '{SEGMENTS[3]}'
    ELSE '{SEGMENTS[4]}' END AS segment
  FROM made)"""


# --- decision and outcome logs from the event table ---


def as_decisions(events: DataFrame) -> DataFrame:
    """Every event but a purchase is a decision about an offer."""
    return events.where(F.col("event_type") != "purchase").select(
        "event_id",
        "user_id",
        F.col("ts").alias("decided_at"),
        pick(SEGMENTS, F.col("user_id") % 5).alias("segment"),
        pick(ARMS, (F.col("event_id") * 7 + F.col("user_id")) % 5).alias("arm"),
    )


def as_outcomes(events: DataFrame) -> DataFrame:
    """A purchase is the outcome of an earlier event; some point at no decision, some repeat."""
    back = F.get_json_object("props", "$.k").cast("bigint") * 17 % 900 + 1
    return events.where(F.col("event_type") == "purchase").select(
        (F.col("event_id") - back).alias("event_id"),
        (F.col("value") >= 20).cast("int").alias("reward"),
        F.col("ts").alias("observed_at"),
    )


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    return as_decisions(load(spark, folder, "events"))


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return as_outcomes(load(spark, folder, "events"))


def offer_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every decision with its reward, 0 while there is no outcome."""
    return join_outcomes(decisions(spark, folder), outcomes(spark, folder), "event_id", "observed_at")


LOGS = f"""
decisions AS (
  SELECT event_id, user_id, ts AS decided_at, {sql_list(SEGMENTS)}[user_id % 5 + 1] AS segment,
    {sql_list(ARMS)}[(event_id * 7 + user_id) % 5 + 1] AS arm
  FROM events WHERE event_type <> 'purchase'),
outcomes AS (
  SELECT event_id - (CAST(json_extract_string(props, '$.k') AS BIGINT) * 17 % 900 + 1) AS event_id,
    CAST(value >= 20 AS INTEGER) AS reward, ts AS observed_at
  FROM events WHERE event_type = 'purchase'),
first_outcomes AS (
  SELECT event_id, first(reward ORDER BY observed_at, reward) AS reward, min(observed_at) AS observed_at
  FROM outcomes GROUP BY event_id),
offer_log AS (
  SELECT d.*, coalesce(o.reward, 0) AS reward, o.observed_at
  FROM decisions d LEFT JOIN first_outcomes o USING (event_id))"""


# --- labelled texts with a score to evaluate ---


def scored_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Quality label of a text beside a crude score: its share of distinct words."""
    words = F.split(F.trim("text"), r"[ \n\r\t\f]+")
    texts = load(spark, folder, "documents").select(
        "doc_id",
        F.round(F.size(F.array_distinct(words)) / F.size(words), 3).alias("score"),
        F.size(words).alias("n_words"),
        "n_chars",
    )
    return load(spark, folder, "labels").join(texts, "doc_id")


SCORED = r"""
words AS (SELECT doc_id, n_chars, string_split_regex(trim(text), '[ \n\r\t\f]+') AS w FROM documents),
scored AS (
  SELECT l.doc_id, l.quality, l.toxic, round(len(list_distinct(w)) / len(w), 3) AS score, n_chars
  FROM labels l JOIN words USING (doc_id))"""
