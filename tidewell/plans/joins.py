"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import joins as J
from tidewell.operators.aggregates import mean_of
from tidewell.operators.offers import OFFERS, SEGMENT_MULTIPLIERS, best_offer, offer_table
from tidewell.plans.common import CLIENTS, LOGS, PLACES, clients, decisions, outcomes
from tidewell.plans.registry import query
from tidewell.plans.relational import LINE_KEY, LINE_KEY_SQL
from tidewell.tables import load

OFFER_VALUES = "offers(position, offer_id, channel, duration_months, rate, base_conversion_rate) AS (VALUES " + ", ".join(
    f"({i}, '{o[0]}', '{o[1]}', {o[2]}, {o[3]}::DOUBLE, {o[5]}::DOUBLE)" for i, o in enumerate(OFFERS)
) + ")"
AFFINITY_VALUES = "affinity(offer_id, segments) AS (VALUES " + ", ".join(
    f"('{o[0]}', [{', '.join(repr(s) for s in o[4])}])" for o in OFFERS
) + ")"


@query("join_agg_back", f"""
SELECT {LINE_KEY_SQL}, avg(l_quantity) OVER (PARTITION BY l_suppkey) AS mean_quantity,
  count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem""")
def join_agg_back(spark, d):
    stats = {"mean_quantity": mean_of(F.col("l_quantity"), PLACES), "n": F.count("*")}
    rows = load(spark, d, "lineitem").select(*LINE_KEY, "l_quantity")
    return J.with_group_stats(rows, ["l_suppkey"], stats).drop("l_quantity")


@query("join_multikey", f"""
SELECT {LINE_KEY_SQL}, CAST(sum(CAST(l_discount AS DECIMAL(24,4))) OVER w AS DOUBLE) / count(l_discount) OVER w AS mean_discount,
  count(*) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_partkey, l_suppkey)""")
def join_multikey(spark, d):
    stats = {"mean_discount": mean_of(F.col("l_discount"), PLACES), "n": F.count("*")}
    rows = load(spark, d, "lineitem").select(*LINE_KEY, "l_discount")
    return J.with_group_stats(rows, ["l_partkey", "l_suppkey"], stats).drop("l_discount")


@query("join_outcomes_left", f"""
WITH {LOGS}, hits AS (SELECT d.event_id, first(reward ORDER BY observed_at, reward) AS r, min(observed_at) AS observed_at FROM decisions d JOIN outcomes o
  ON d.event_id = o.event_id AND o.observed_at BETWEEN decided_at AND decided_at + INTERVAL 2 DAY GROUP BY 1)
SELECT event_id, user_id, decided_at, segment, arm, coalesce(r, 0) AS reward, observed_at FROM decisions LEFT JOIN hits USING (event_id)""")
def join_outcomes_left(spark, d):
    return J.join_outcomes(
        decisions(spark, d), outcomes(spark, d), "event_id", "observed_at", decided="decided_at", horizon_days=2
    )


@query("join_outcomes_inner", f"""
WITH {LOGS} SELECT d.*, reward, observed_at FROM decisions d JOIN first_outcomes USING (event_id)""")
def join_outcomes_inner(spark, d):
    return J.join_outcomes(decisions(spark, d), outcomes(spark, d), "event_id", "observed_at", how="inner")


@query("join_order_lines", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate, o_custkey, o_orderdate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def join_order_lines(spark, d):
    from tidewell.operators.attach import attach

    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    lines = load(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"
    )
    return attach(lines, orders, ["l_orderkey"], how="inner")


@query("join_full_align", """
WITH a AS (SELECT p_brand, round(avg(p_retailprice), 6) AS mean_price FROM part WHERE p_brand <> 'Brand#3' GROUP BY 1),
b AS (SELECT p_brand, count(*) AS small_parts FROM part WHERE p_size < 20 AND p_brand <> 'Brand#7' GROUP BY 1)
SELECT p_brand, mean_price, small_parts FROM a FULL JOIN b USING (p_brand) ORDER BY 1""")
def join_full_align(spark, d):
    part = load(spark, d, "part")
    big = part.where("p_brand <> 'Brand#3'").groupBy("p_brand").agg(
        F.round(mean_of(F.col("p_retailprice"), PLACES), 6).alias("mean_price")
    )
    small = part.where("p_size < 20 AND p_brand <> 'Brand#7'").groupBy("p_brand").agg(
        F.count("*").alias("small_parts")
    )
    return J.align(big, small, ["p_brand"])


@query("cross_client_offer", f"""
WITH {OFFER_VALUES} SELECT c_custkey, offer_id, duration_months, rate FROM customer CROSS JOIN offers""")
def cross_client_offer(spark, d):
    offers = offer_table(spark).select("offer_id", "duration_months", "rate")
    return J.pair_with_all(load(spark, d, "customer").select("c_custkey"), offers)


@query("join_static_map", f"""
WITH {CLIENTS} SELECT client, segment, CASE segment {' '.join(f"WHEN '{s}' THEN {m}" for s, m in list(SEGMENT_MULTIPLIERS.items())[:3])}
  ELSE 1.0 END::DOUBLE AS multiplier FROM clients""")
def join_static_map(spark, d):
    known = dict(list(SEGMENT_MULTIPLIERS.items())[:3])
    return J.static_lookup(clients(spark, d).select("client", "segment"), "segment", known, 1.0, "multiplier")


@query("score_distinct", f"""
SELECT {LINE_KEY_SQL}, round(l_quantity * (1 - l_discount) * (1 + l_tax), 6) AS score FROM lineitem""")
def score_distinct(spark, d):
    features = ["l_quantity", "l_discount", "l_tax"]

    def score(tuples):
        value = F.col("l_quantity") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
        return tuples.withColumn("score", F.round(value, 6))

    rows = load(spark, d, "lineitem").select(*LINE_KEY, *features)
    return J.score_distinct(rows, features, score, "score").drop(*features)


@query("join_context", f"""
WITH {LOGS} SELECT o.event_id, reward, observed_at, user_id, segment, arm, true AS known FROM outcomes o JOIN decisions USING (event_id)
UNION ALL SELECT event_id, reward, observed_at, NULL, NULL, NULL, false FROM outcomes
WHERE event_id NOT IN (SELECT event_id FROM decisions)""")
def join_context(spark, d):
    context = decisions(spark, d).drop("decided_at")
    known, unknown = J.recover_context(outcomes(spark, d), context, "event_id")
    return known.withColumn("known", F.lit(True)).unionByName(
        unknown.withColumn("known", F.lit(False)), allowMissingColumns=True
    )


@query("parent_children", """
WITH placed AS (SELECT o_custkey AS c_custkey, o_orderkey,
    (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5 AS page FROM orders),
lists AS (SELECT c_custkey, page, list(o_orderkey ORDER BY o_orderkey) AS children FROM placed GROUP BY 1, 2)
SELECT c_custkey, c_name, coalesce(page, 0) AS page, coalesce(children, []) AS children
FROM customer LEFT JOIN lists USING (c_custkey)""")
def parent_children(spark, d):
    parents = load(spark, d, "customer").select("c_custkey", "c_name")
    return J.parents_with_children(
        parents, "c_custkey", load(spark, d, "orders"), "o_custkey", "o_orderkey", page_size=5
    )


@query("argmax_group", f"""
WITH {OFFER_VALUES}, s AS (
  SELECT c_custkey, position, offer_id, (c_custkey * (position + 3)) % 7 AS score FROM customer CROSS JOIN offers)
SELECT c_custkey, first(offer_id ORDER BY score DESC, position) AS best_arm, max(score) AS best_value FROM s GROUP BY 1""")
def argmax_group(spark, d):
    offers = offer_table(spark).select("position", "offer_id")
    pairs = J.pair_with_all(load(spark, d, "customer").select("c_custkey"), offers)
    scored = pairs.withColumn("score", F.col("c_custkey") * (F.col("position") + 3) % 7)
    return best_offer(scored, ["c_custkey"], "offer_id", "score", "position")


@query("array_membership", f"""
WITH {CLIENTS}, {AFFINITY_VALUES}
SELECT client, segment, offer_id, list_contains(segments, segment) AS has_affinity FROM clients CROSS JOIN affinity""")
def array_membership(spark, d):
    offers = offer_table(spark).select("offer_id", "segment_affinity")
    pairs = J.pair_with_all(clients(spark, d).select("client", "segment"), offers)
    return pairs.withColumn(
        "has_affinity", F.array_contains("segment_affinity", F.col("segment"))
    ).drop("segment_affinity")
