"""Queries of the scans, sinks and catalog operators: written, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.columns import candle_columns, date_key
from tidewell.operators.offers import policy_metrics, run_report
from tidewell.operators.relational import append_batches
from tidewell.operators.windows import daily_bars, expanding_mean
from tidewell.plans.common import BARS, LOGS, PLACES, bars, offer_log
from tidewell.plans.registry import query
from tidewell.session import scratch_path
from tidewell.sources import catalog as K
from tidewell.sources import files as S
from tidewell.tables import load

DATABASE = "tidewell"


@query("scan_csv", "SELECT * FROM orders")
def scan_csv(spark, d):
    orders, path = load(spark, d, "orders"), scratch_path(spark, "scan-csv")
    S.write_delimited(orders, path)
    return S.read_delimited(spark, path, orders.schema)


@query("scan_csv_inferred", "SELECT p_partkey::INTEGER AS p_partkey, p_name, p_size, p_retailprice FROM part")
def scan_csv_inferred(spark, d):
    path = scratch_path(spark, "scan-inferred")
    S.write_delimited(load(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path)
    return S.read_delimited(spark, path)


@query("scan_ssv", "SELECT * FROM customer")
def scan_ssv(spark, d):
    customer, path = load(spark, d, "customer"), scratch_path(spark, "scan-ssv")
    S.write_delimited(S.with_index_column(customer, F.col("c_custkey")), path, sep=";")
    return S.read_indexed_ssv(spark, path, customer.schema)


def _daily_events(spark, d):
    return load(spark, d, "events").withColumn("dataproc", date_key(F.col("ts")))


def _registered(spark, d, label):
    """A fresh external table over partitioned events; returns its name."""
    path = scratch_path(spark, label)
    events = _daily_events(spark, d)
    S.write_partitioned(events, path, "dataproc")
    K.ensure_database(spark, DATABASE, scratch_path(spark, "database"))
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    K.register_table(spark, DATABASE, table, events.schema, path, ["dataproc"])
    K.repair_partitions(spark, DATABASE, table)
    return table


@query("scan_catalog", """
SELECT *, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS dataproc FROM events WHERE ts >= TIMESTAMP '2024-01-10'
  AND ts < TIMESTAMP '2024-01-21'""")
def scan_catalog(spark, d):
    table = K.scan_table(spark, DATABASE, _registered(spark, d, "scan"))
    return table.where(F.col("dataproc").between(20240110, 20240120))


@query("scan_jsonl", """
SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def scan_jsonl(spark, d):
    events, path = load(spark, d, "events"), scratch_path(spark, "scan-jsonl")
    nested = T.StructType([T.StructField("k", T.LongType())])
    S.write_json_lines(events.withColumn("props", F.from_json("props", nested)), path)
    schema = T.StructType([f if f.name != "props" else T.StructField("props", nested) for f in events.schema])
    good, _ = S.read_json_lines(spark, path, schema)
    return good.select("event_id", "ts", "user_id", "event_type", "value", "props.k")


@query("split_log", """
SELECT CASE WHEN event_type = 'purchase' THEN 'reward' ELSE 'decision' END AS shape, event_id FROM events""")
def split_log(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "reward")
    log = load(spark, d, "events").select("event_id", kind.alias("type"))
    path = scratch_path(spark, "split-log")
    S.write_json_lines(log, path)
    good, _ = S.read_json_lines(spark, path, log.schema)
    decided, rewarded = S.split_shapes(good)
    return append_batches(
        decided.select("event_id", F.lit("decision").alias("shape")),
        rewarded.select("event_id", F.lit("reward").alias("shape")),
    )


@query("ingest_quotes", f"""
WITH {BARS} SELECT series, day AS "Date", CAST(strftime(day, '%Y%m%d') AS INTEGER) AS dataproc, open AS "Open",
  high AS "High", low AS "Low", close AS "Close", volume AS "Volume" FROM bars""")
def ingest_quotes(spark, d):
    awkward = {c: f"('{c.title()}', '^EVT')" for c in ("open", "high", "low", "close", "volume")}
    raw = bars(spark, d).withColumnsRenamed({**awkward, "day": "('Date', '')"})
    flat = S.flatten_quote_columns(raw)
    return flat.withColumn("dataproc", date_key(F.col("Date")))


@query("sink_partitioned_parquet", """
SELECT CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS dataproc, count(*) AS n FROM events GROUP BY 1""")
def sink_partitioned_parquet(spark, d):
    path = scratch_path(spark, "sink-parquet")
    S.write_partitioned(_daily_events(spark, d), path, "dataproc")
    return spark.read.parquet(path).groupBy("dataproc").agg(F.count("*").alias("n"))


@query("sink_incremental", """
SELECT CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS dataproc,
  CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 2 * count(*) ELSE count(*) END AS n
FROM (SELECT date_trunc('day', ts) AS ts FROM events) GROUP BY date_trunc('day', ts), 1, ts""")
def sink_incremental(spark, d):
    """Rewriting some partitions leaves the others alone."""
    path, events = scratch_path(spark, "sink-incremental"), _daily_events(spark, d)
    S.write_partitioned(events, path, "dataproc")
    late = events.where("ts >= TIMESTAMP_NTZ '2024-01-20'")
    S.write_partitioned(late.unionByName(late), path, "dataproc", incremental=True)
    return spark.read.parquet(path).groupBy("dataproc").agg(F.count("*").alias("n"))


@query("sink_csv", "SELECT * FROM nation")
def sink_csv(spark, d):
    nation, path = load(spark, d, "nation"), scratch_path(spark, "sink-csv")
    S.write_delimited(nation, path, single_file=True)
    return S.read_delimited(spark, path, nation.schema)


@query("sink_jsonl", "SELECT event_id, event_type, value FROM events UNION ALL SELECT event_id, event_type, value FROM events")
def sink_jsonl(spark, d):
    path = scratch_path(spark, "sink-jsonl")
    events = load(spark, d, "events").select("event_id", "event_type", "value")
    S.write_json_lines(events, path)
    S.write_json_lines(events, path, append=True)
    return S.read_json_lines(spark, path, events.schema)[0]


@query("sink_csv_two_copies", "SELECT 1 AS copy, * FROM region UNION ALL SELECT 2, * FROM region")
def sink_csv_two_copies(spark, d):
    region = load(spark, d, "region")
    first, second = scratch_path(spark, "copy-a"), scratch_path(spark, "copy-b")
    S.write_two_copies(region, first, second)
    copies = [S.read_delimited(spark, p, region.schema).withColumn("copy", F.lit(i)) for i, p in ((1, first), (2, second))]
    return append_batches(*copies)


@query("sink_report", f"""
WITH {LOGS} SELECT count(*) AS total_rounds, CAST(sum(reward) AS BIGINT) AS total_reward,
  round(sum(reward) / count(*), 4) AS conversion_rate FROM offer_log""")
def sink_report(spark, d):
    path = scratch_path(spark, "report")
    metrics = policy_metrics(offer_log(spark, d), "arm", "reward")
    S.write_report(run_report(metrics, metrics.columns), path)
    fields = "total_rounds bigint, total_reward bigint, conversion_rate double"
    return spark.read.text(path).select(F.from_json("value", fields).alias("r")).select("r.*")


@query("replace_table_with_id", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, * FROM part")
def replace_table_with_id(spark, d):
    K.ensure_database(spark, DATABASE, scratch_path(spark, "database"))
    path = scratch_path(spark, "books")
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    part = load(spark, d, "part")
    for _ in range(2):
        K.replace_table_with_id(part, DATABASE, table, [F.col("p_partkey")], path=path)
    return K.scan_table(spark, DATABASE, table)


@query("catalog_register", """
SELECT CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS dataproc, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def catalog_register(spark, d):
    table = K.scan_table(spark, DATABASE, _registered(spark, d, "register"))
    return table.groupBy("dataproc", "event_type").agg(F.count("*").alias("n"))


@query("catalog_repair", "SELECT DISTINCT 'dataproc=' || strftime(ts, '%Y%m%d') AS partition FROM events")
def catalog_repair(spark, d):
    return K.list_partitions(spark, DATABASE, _registered(spark, d, "repair"))


@query("stage_handover", f"""
WITH {BARS} SELECT series, day, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS dataproc, close,
  round(close - open, 4) AS candle_body,
  round(CAST(sum(CAST(close AS DECIMAL(24,4))) OVER w AS DOUBLE) / count(close) OVER w, 2) AS moving_mean
FROM bars WINDOW w AS (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING)""")
def stage_handover(spark, d):
    """Extract, transform, load: each stage starts from the files behind the marker."""
    raw, final = scratch_path(spark, "stage-raw"), scratch_path(spark, "stage-final")
    extracted = daily_bars(load(spark, d, "events"), "event_type", "ts", "value", "event_id").withColumn(
        "dataproc", date_key(F.col("day"))
    )
    S.write_partitioned(extracted, raw, "dataproc")
    S.mark_complete(spark, raw, "_EXTRACT_COMPLETE")
    ready = S.read_when_complete(spark, raw, "_EXTRACT_COMPLETE", extracted.schema)
    body = F.round(candle_columns("open", "high", "low", "close")["candle_body"], 4)
    loaded = expanding_mean(ready, "series", "day", "close", "moving_mean", decimals=PLACES).withColumn("candle_body", body)
    loaded = loaded.select("series", "day", "close", "candle_body", "moving_mean", "dataproc")
    S.write_partitioned(loaded, final, "dataproc")
    S.mark_complete(spark, final, "_LOAD_COMPLETE")
    return S.read_when_complete(spark, final, "_LOAD_COMPLETE", loaded.schema)


@query("cached_dimension", """
SELECT c_custkey, cn.n_name AS customer_nation, o.n_orders FROM customer
JOIN nation cn ON c_nationkey = cn.n_nationkey
JOIN (SELECT c_nationkey AS k, count(*) AS n_orders FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) o ON o.k = c_nationkey""")
def cached_dimension(spark, d):
    nation = S.cached_dimension(spark, f"{d}/nation.parquet").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_nation")
    )
    customers = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    per = customers.join(nation, "c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("n_orders"))
    return (
        customers.join(nation, "c_nationkey").join(S.broadcast_if_small(per), "c_nationkey").drop("c_nationkey")
    )
