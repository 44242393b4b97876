"""Queries of the keyed-table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import changes as C
from tidewell.plans.registry import query
from tidewell.tables import load

FIELDS = ["o_orderstatus", "o_totalprice"]


def orders(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_custkey", *FIELDS)


ORDERS = "base AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders)"


@query("apply_inserts", f"""
WITH {ORDERS}, new AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000)
SELECT * FROM base UNION ALL
SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey), c_custkey, 'N', c_acctbal FROM new""")
def apply_inserts(spark, d):
    new = load(spark, d, "customer").where("c_acctbal > 5000").select(
        F.col("c_custkey").alias("o_custkey"), F.lit("N").alias("o_orderstatus"), F.col("c_acctbal").alias("o_totalprice")
    )
    return C.append_with_ids(orders(spark, d), new, "o_orderkey", ["o_custkey"])


def _updates(spark, d):
    """Events as partial updates of orders; a field that is not given is null."""
    events = load(spark, d, "events")
    return events.select(
        (F.col("event_id") % 4000 * 2).alias("o_orderkey"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "view", "V").alias("o_orderstatus"),
        F.when(F.col("event_type") != "click", F.col("value")).alias("o_totalprice"),
    )


UPDATES = """
updates AS (SELECT event_id % 4000 * 2 AS o_orderkey, event_id AS seq,
  CASE WHEN event_type = 'view' THEN 'V' END AS o_orderstatus,
  CASE WHEN event_type <> 'click' THEN value END AS o_totalprice FROM events)"""


@query("apply_updates", f"""
WITH {ORDERS}, {UPDATES}, latest AS (SELECT o_orderkey,
    last(o_orderstatus ORDER BY seq) FILTER (o_orderstatus IS NOT NULL) AS s,
    last(o_totalprice ORDER BY seq) FILTER (o_totalprice IS NOT NULL) AS p FROM updates GROUP BY 1)
SELECT b.o_orderkey, o_custkey, coalesce(s, o_orderstatus) AS o_orderstatus, coalesce(p, o_totalprice) AS o_totalprice
FROM base b LEFT JOIN latest USING (o_orderkey)""")
def apply_updates(spark, d):
    return C.apply_updates(orders(spark, d), _updates(spark, d), "o_orderkey", "seq", FIELDS)


@query("apply_deletes", f"""
WITH {ORDERS}, gone AS (SELECT DISTINCT event_id * 3 AS o_orderkey FROM events)
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, true AS known FROM base
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM gone)
UNION ALL SELECT o_orderkey, NULL, NULL, NULL, false FROM gone WHERE o_orderkey NOT IN (SELECT o_orderkey FROM base)""")
def apply_deletes(spark, d):
    """The remaining rows, then the requested keys that do not exist."""
    gone = load(spark, d, "events").select((F.col("event_id") * 3).alias("o_orderkey"))
    left, unknown = C.apply_deletes(orders(spark, d), gone, "o_orderkey")
    return left.withColumn("known", F.lit(True)).unionByName(
        unknown.withColumn("known", F.lit(False)), allowMissingColumns=True
    )


def change_log(spark, d):
    """A mixed log of inserts, updates and deletes derived from the events."""
    events = load(spark, d, "events")
    kind = (
        F.when(F.col("event_type") == "signup", "insert")
        .when(F.col("event_type") == "error", "delete")
        .otherwise("update")
    )
    spread = events.agg(F.count("*").alias("n"))
    return events.crossJoin(F.broadcast(spread)).select(
        (F.col("event_id") * 7 % F.greatest(F.floor(F.col("n") / 4), F.lit(1)) * 9).alias("o_orderkey"),
        F.col("event_id").alias("seq"),
        kind.alias("op"),
        F.when(kind != "delete", F.col("user_id")).alias("o_custkey"),
        F.when(F.col("event_type").isin("view", "signup"), F.upper(F.substring("event_type", 1, 1))).alias("o_orderstatus"),
        F.when(F.col("event_type").isin("purchase", "signup"), F.col("value")).alias("o_totalprice"),
    )


CHANGES = """
log AS (SELECT event_id * 7 % greatest((SELECT count(*) FROM events) // 4, 1) * 9 AS o_orderkey, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
  CASE WHEN event_type <> 'error' THEN user_id END AS o_custkey,
  CASE WHEN event_type IN ('view', 'signup') THEN upper(event_type[1]) END AS o_orderstatus,
  CASE WHEN event_type IN ('purchase', 'signup') THEN value END AS o_totalprice FROM events),
keys AS (SELECT o_orderkey FROM base UNION SELECT o_orderkey FROM log),
ends AS (SELECT k.o_orderkey, max(seq) FILTER (op = 'delete') AS gone FROM keys k LEFT JOIN log USING (o_orderkey) GROUP BY 1),
starts AS (SELECT e.o_orderkey, any_value(gone) AS gone, min(seq) FILTER (op = 'insert' AND (gone IS NULL OR seq > gone)) AS began
  FROM ends e LEFT JOIN log USING (o_orderkey) GROUP BY 1),
alive AS (SELECT s.o_orderkey, b.o_custkey AS c, b.o_orderstatus AS s, b.o_totalprice AS p, began,
  b.o_orderkey IS NOT NULL AND gone IS NULL AS kept FROM starts s LEFT JOIN base b USING (o_orderkey)),
effective AS (SELECT a.o_orderkey, seq, l.o_custkey, l.o_orderstatus, l.o_totalprice FROM alive a JOIN log l USING (o_orderkey)
  WHERE op <> 'delete' AND (kept OR seq >= began)),
final AS (SELECT o_orderkey, last(o_custkey ORDER BY seq) FILTER (o_custkey IS NOT NULL) AS nc,
  last(o_orderstatus ORDER BY seq) FILTER (o_orderstatus IS NOT NULL) AS ns,
  last(o_totalprice ORDER BY seq) FILTER (o_totalprice IS NOT NULL) AS np FROM effective GROUP BY 1),
changed AS (SELECT a.o_orderkey, coalesce(nc, CASE WHEN kept THEN c END) AS o_custkey,
  coalesce(ns, CASE WHEN kept THEN s END) AS o_orderstatus, coalesce(np, CASE WHEN kept THEN p END) AS o_totalprice
  FROM alive a LEFT JOIN final USING (o_orderkey) WHERE kept OR began IS NOT NULL)"""


@query("apply_changes", f"WITH {ORDERS}, {CHANGES} SELECT * FROM changed")
def apply_changes(spark, d):
    return C.apply_changes(orders(spark, d), change_log(spark, d), "o_orderkey", "seq", "op")


@query("unique_key_guard", """
WITH new AS (SELECT o_custkey * 2 AS c_custkey, o_orderkey AS seq FROM orders),
j AS (SELECT *, CASE WHEN c_custkey IN (SELECT c_custkey FROM customer) THEN 'key taken'
  WHEN seq <> min(seq) OVER (PARTITION BY c_custkey) THEN 'repeated in batch' END AS reason FROM new)
SELECT c_custkey, seq, reason FROM j""")
def unique_key_guard(spark, d):
    new = load(spark, d, "orders").select((F.col("o_custkey") * 2).alias("c_custkey"), F.col("o_orderkey").alias("seq"))
    accepted, refused = C.guard_unique(load(spark, d, "customer"), new, "c_custkey", "seq")
    return accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(refused)
