"""Queries of the offer, drift, approval and version operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewell.functions.columns import SEGMENTS, uniform
from tidewell.operators import features as E
from tidewell.operators import models as M
from tidewell.operators import monitor as D
from tidewell.operators import offers as B
from tidewell.operators.joins import join_outcomes, pair_with_all
from tidewell.operators.metrics import area_under_roc
from tidewell.plans.common import CLIENTS, LOGS, SCORED, clients, decisions, offer_log, outcomes, scored_labels, sql_list
from tidewell.plans.joins import AFFINITY_VALUES, OFFER_VALUES
from tidewell.plans.models import UNIFORM
from tidewell.plans.registry import query
from tidewell.session import spread, stage
from tidewell.tables import load


@query("offer_catalog", f"""
WITH {OFFER_VALUES}, {AFFINITY_VALUES}, {LOGS},
texts(offer_id, name, description) AS (VALUES {", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in B.OFFER_TEXTS.items())})
SELECT o.position, offer_id, name, description, channel, duration_months, rate, segments AS segment_affinity, base_conversion_rate, coalesce(n, 0) AS rounds
FROM offers o JOIN affinity USING (offer_id) JOIN texts USING (offer_id) LEFT JOIN (SELECT arm AS offer_id, count(*) AS n FROM decisions GROUP BY 1) USING (offer_id)""")
def offer_catalog(spark, d):
    """The offers beside how often the log shows them, 0 for one it never shows."""
    rounds = decisions(spark, d).groupBy(F.col("arm").alias("offer_id")).agg(F.count("*").alias("rounds"))
    return B.with_rounds(B.offer_table(spark), rounds)


@query("context_validate", f"""
WITH {CLIENTS}, c AS (SELECT client, CASE WHEN client % 5 <> 0 THEN age END AS age, CASE WHEN client % 7 <> 0 THEN job END AS job, pdays FROM clients)
SELECT client, list_filter([CASE WHEN age IS NULL THEN 'age' END, CASE WHEN job IS NULL THEN 'job' END, 'campaign'], lambda x: x IS NOT NULL) AS missing,
  false AS valid, age IS NOT NULL AND job IS NOT NULL AS valid_without_campaign FROM c""")
def context_validate(spark, d):
    rows = clients(spark, d).select(
        "client", F.when(F.col("client") % 5 != 0, F.col("age")).alias("age"),
        F.when(F.col("client") % 7 != 0, F.col("job")).alias("job"), "pdays",
    )
    short = B.check_context(rows, ["age", "job", "pdays"]).withColumnRenamed("valid", "valid_without_campaign").drop("missing")
    return B.check_context(short, ["age", "job", "campaign", "pdays"]).select(
        "client", "missing", "valid", "valid_without_campaign"
    )


ESTIMATES = f"""{LOGS},
grid AS (SELECT s.segment, a.position, a.arm FROM (SELECT unnest({sql_list(SEGMENTS)}) AS segment) s CROSS JOIN
  (SELECT unnest({sql_list(B.ARMS)}) AS arm, CAST(unnest(range({len(B.ARMS)})) AS INTEGER) AS position) a),
counts AS (SELECT segment, arm, count(*) FILTER (reward = 1) AS hits, count(*) FILTER (reward = 0) AS misses FROM offer_log GROUP BY 1, 2),
filled AS (SELECT segment, position, arm, coalesce(hits, 0) AS hits, coalesce(misses, 0) AS misses, coalesce(hits, 0) + 1.0::DOUBLE AS a, coalesce(misses, 0) + 1.0::DOUBLE AS b
  FROM grid LEFT JOIN counts USING (segment, arm)),
estimates AS (SELECT segment, position, arm, hits, misses, a / (a + b) AS mean, sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS std FROM filled)"""


def estimates(spark, d):
    return B.posterior_estimates(offer_log(spark, d), "segment", "arm", "reward")


@query("posterior_estimates", f"WITH {ESTIMATES} SELECT segment, position, arm, hits, misses, round(mean, 9) AS mean, round(std, 9) AS std FROM estimates")
def posterior_estimates(spark, d):
    return estimates(spark, d).withColumns({c: F.round(c, 9) for c in ("mean", "std")})


OFFER_FEATURES = ["duration_months", "rate"]


@query("bootstrap_estimates", f"""
WITH {CLIENTS}, {OFFER_VALUES} SELECT client, offer_id, true AS is_share, true AS spread FROM clients CROSS JOIN offers""")
def bootstrap_estimates(spark, d):
    """Mean and deviation over thirty logistic models of offer and client features, per client and offer."""
    offers = B.offer_table(spark).select("offer_id", *(F.col(c).cast("double") for c in OFFER_FEATURES))
    scaled = E.scale_minmax(offers, E.fit_range(offers, OFFER_FEATURES), OFFER_FEATURES, low=0.0, high=1.0)
    flags = [(F.col("segment") == s).cast("double").alias(f"segment{i}") for i, s in enumerate(SEGMENTS[:-1])]
    columns = [*OFFER_FEATURES, *(f"segment{i}" for i in range(len(flags)))]
    log = offer_log(spark, d).join(F.broadcast(scaled), F.col("arm") == F.col("offer_id"))
    # read twice: the joined log is written once, then dealt out, since thirty draws a row are much work
    train = E.class_weights(stage(log.select("event_id", *OFFER_FEATURES, *flags, "reward"), "offer_log"), "reward")
    members = M.fit_ensemble(spread(train), columns, "reward", "event_id", balance="weight")
    people = pair_with_all(spread(clients(spark, d).select("client", *flags)), scaled)
    out = M.ensemble_scores(members, people)
    return out.select("client", "offer_id", F.col("mean").between(0, 1).alias("is_share"), (F.col("std") > 0).alias("spread"))


NORMAL = "sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {a})) * cos(6.283185307179586::DOUBLE * {b})".format(
    a=UNIFORM.format("client || '|' || arm", "42a"), b=UNIFORM.format("client || '|' || arm", "42b")
)


@query("thompson_choose", f"""
WITH {CLIENTS}, {ESTIMATES.strip()},
samples AS (SELECT client, c.segment, position, arm, mean, std, greatest(0.0::DOUBLE, least(1.0::DOUBLE, mean + greatest(std, 0.0001::DOUBLE) * {NORMAL})) AS sample
  FROM clients c JOIN estimates e ON c.segment = e.segment),
best AS (SELECT * FROM samples QUALIFY row_number() OVER (PARTITION BY client ORDER BY sample DESC, position) = 1)
SELECT client, segment, arm AS arm_chosen, 'v1.0' AS policy_version, round(mean * 100, 2) AS estimated_conversion, round(std, 4) AS uncertainty_std,
  std > 0.05 AS exploring, round(sample, 4) AS ts_sample, every AS estimates FROM best JOIN
  (SELECT segment, list({{'arm': arm, 'mean': round(mean, 6), 'std': round(std, 6)}} ORDER BY position) AS every FROM estimates GROUP BY 1) USING (segment)""")
def thompson_choose(spark, d):
    people = clients(spark, d).select("client", "segment")
    return B.thompson_choose(people, "client", "segment", estimates(spark, d))


@query("baseline_choose", "SELECT c_custkey, 'reativacao' AS arm_chosen, 0.28::DOUBLE AS known_rate FROM customer")
def baseline_choose(spark, d):
    return B.baseline_choose(load(spark, d, "customer").select("c_custkey"))


@query("offer_propensity", f"""
WITH {CLIENTS}, {AFFINITY_VALUES},
people AS (SELECT client, CASE WHEN client % 11 = 0 THEN NULL WHEN client % 13 = 0 THEN 'unheard_of' ELSE segment END AS segment FROM clients),
w AS (SELECT client, segment, offer_id, 1.0::DOUBLE + CASE WHEN list_contains(segments, segment) THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS w
  FROM people CROSS JOIN affinity)
SELECT client, segment, offer_id, round(w / sum(w) OVER (PARTITION BY client), 9) AS propensity FROM w""")
def offer_propensity(spark, d):
    k = F.col("client")
    lost = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.lit("unheard_of")).otherwise(F.col("segment"))
    people = clients(spark, d).select("client", lost.alias("segment"))
    out = B.offer_propensity(people, "segment", B.offer_table(spark))
    return out.withColumn("propensity", F.round("propensity", 9))


METRICS_SQL = """count(*) AS total_rounds, CAST(sum(reward) AS BIGINT) AS total_reward, round(sum(reward) / count(*), 4) AS conversion_rate,
  round(count(*) * 0.28::DOUBLE - sum(reward), 2) AS cumulative_regret, round(count(*) FILTER (arm <> 'reativacao') / count(*), 4) AS exploration_rate"""
SCALARS = ["total_rounds", "total_reward", "conversion_rate", "cumulative_regret", "exploration_rate"]


@query("policy_metrics", f"""
WITH {LOGS}, c AS (SELECT arm, count(*) AS n FROM offer_log GROUP BY 1)
SELECT {METRICS_SQL}, (SELECT '{{' || string_agg('"' || arm || '":' || n, ',' ORDER BY arm) || '}}' FROM c) AS arm_counts FROM offer_log""")
def policy_metrics(spark, d):
    return B.policy_metrics(offer_log(spark, d), "arm", "reward").drop("arm_rates")


@query("cumulative_regret", f"""
WITH {LOGS} SELECT segment, event_id, round(sum(0.28::DOUBLE - reward) OVER (PARTITION BY segment ORDER BY decided_at, event_id ROWS UNBOUNDED PRECEDING), 4) AS regret FROM offer_log""")
def cumulative_regret(spark, d):
    from tidewell.operators.windows import running_total

    regret = F.lit(B.KNOWN_RATES[B.BEST_ARM]).cast("decimal(18,2)") - F.col("reward").cast("decimal(18,2)")
    out = running_total(offer_log(spark, d), ["segment"], ["decided_at", "event_id"], regret, "regret")
    return out.select("segment", "event_id", F.round(F.col("regret").cast("double"), 4).alias("regret"))


@query("policy_compare", f"""
WITH {LOGS} SELECT CASE WHEN user_id % 2 = 0 THEN 'thompson' ELSE 'baseline' END AS policy, {METRICS_SQL} FROM offer_log GROUP BY 1""")
def policy_compare(spark, d):
    policy = F.when(F.col("user_id") % 2 == 0, "thompson").otherwise("baseline")
    return B.policy_metrics(offer_log(spark, d).withColumn("policy", policy), "arm", "reward", ["policy"]).select("policy", *SCALARS)


@query("conversion_probability", f"""
WITH {CLIENTS}, {OFFER_VALUES}
SELECT client, offer_id, round(greatest(0.02::DOUBLE, least(0.90::DOUBLE, base_conversion_rate * CASE segment
  {' '.join(f"WHEN '{s}' THEN {m}::DOUBLE" for s, m in B.SEGMENT_MULTIPLIERS.items())} END)), 9) AS conversion_probability FROM clients CROSS JOIN offers""")
def conversion_probability(spark, d):
    pairs = pair_with_all(clients(spark, d).select("client", "segment"), B.offer_table(spark).select("offer_id"))
    out = B.conversion_probability(pairs, "offer_id", "segment")
    return out.select("client", "offer_id", F.round("conversion_probability", 9).alias("conversion_probability"))


TEMPLATES = "templates(template, segment, arm_expected, case_type, justification) AS (VALUES " + ", ".join(
    f"({i}, '{s}', '{a}', '{k}', '{why}')" for i, ((s, a, k), why) in enumerate(zip(B.GOLDEN_TEMPLATES, B.GOLDEN_REASONS), start=1)
) + ")"
GOLDEN = f"""{LOGS}, {TEMPLATES},
picked AS (SELECT template, case_type, event_id, segment, arm_expected, arm_expected IN ('dep_6m_8pct', 'dep_12m_10pct', 'reativacao') AS likely, '' AS lot,
  justification, 'arm_chosen == "' || arm_expected || '" OU conversion_rate > 0.12' AS pass_criteria, 'arm_chosen em braços com afinidade zero para ' || segment AS fail_criteria
  FROM offer_log JOIN templates USING (segment)
  QUALIFY row_number() OVER (PARTITION BY template ORDER BY md5(event_id || '|' || (42 + template)), event_id) = 1),
filler AS (SELECT {len(B.GOLDEN_TEMPLATES) + 1} AS template, 'random' AS case_type, event_id, segment, arm AS arm_expected, reward = 1 AS likely, md5(event_id || '|42') AS lot,
  '{B.RANDOM_REASON}' AS justification, '{B.RANDOM_PASS}' AS pass_criteria, '{B.RANDOM_FAIL}' AS fail_criteria
  FROM offer_log ORDER BY lot, event_id LIMIT 30),
golden AS (SELECT 'GS_' || lpad(CAST(row_number() OVER (ORDER BY template, lot, event_id) AS VARCHAR), 3, '0') AS case_id,
  case_type, event_id, segment, arm_expected, CAST(likely AS INTEGER) AS reward_expected, justification, pass_criteria, fail_criteria FROM
  (SELECT * FROM picked UNION ALL SELECT * FROM filler) ORDER BY template, lot, event_id LIMIT 30)"""


def golden(spark, d):
    return B.golden_select(offer_log(spark, d), "event_id", "segment", "arm", "reward", n=30)


@query("golden_select", f"WITH {GOLDEN} SELECT * FROM golden")
def golden_select(spark, d):
    return golden(spark, d)


def golden_decisions(spark, d):
    """Logged choices with a derived estimate; the log starts late, so some cases have none, and some have a second, lower one."""
    start = F.lit(datetime(2024, 1, 6)).cast("timestamp_ntz")
    once = decisions(spark, d).where(F.col("decided_at") >= start).select(
        "event_id", F.col("arm").alias("arm_chosen"),
        F.round(uniform(F.col("event_id"), seed="estimate") * 10, 2).alias("estimated_conversion"),
    )
    again = once.where(F.col("event_id") % 3 == 0).withColumn("estimated_conversion", F.col("estimated_conversion") - 1)
    return once.unionByName(again)


EVALUATED = f"""{GOLDEN},
chosen AS (SELECT event_id, arm AS arm_chosen, round({UNIFORM.format('event_id', 'estimate')} * 10, 2) AS estimated_conversion FROM decisions WHERE decided_at >= TIMESTAMP '2024-01-06'),
evaluated AS (SELECT g.*, arm_chosen, estimated_conversion, coalesce(arm_chosen = arm_expected OR estimated_conversion > 5, false) AS passed,
  CASE WHEN arm_chosen IS NULL THEN 'no decision' END AS error FROM golden g LEFT JOIN chosen USING (event_id))"""


@query("golden_evaluate", f"WITH {EVALUATED} SELECT * FROM evaluated")
def golden_evaluate(spark, d):
    return B.golden_evaluate(golden(spark, d), golden_decisions(spark, d), "event_id")


@query("golden_pass_rates", f"""
WITH {EVALUATED} SELECT coalesce(case_type, 'all') AS kind, count(*) AS cases, count(*) FILTER (passed) AS passes,
  round(count(*) FILTER (passed) / count(*), 3) AS pass_rate FROM evaluated GROUP BY ROLLUP (case_type)""")
def golden_pass_rates(spark, d):
    return B.pass_rates(B.golden_evaluate(golden(spark, d), golden_decisions(spark, d), "event_id"), "case_type")


def faulty_records(spark, d):
    """Decision records with the estimates of their segment and faults planted by key arithmetic."""
    k, every = F.col("event_id"), F.col("_tw_estimates")
    by_segment = B.estimates_by_segment(estimates(spark, d))
    return offer_log(spark, d).join(F.broadcast(by_segment), "segment").select(
        F.when(k % 50 != 0, k).alias("event_id"),
        F.when(k % 40 == 0, "unknown_offer").otherwise(F.col("arm")).alias("arm_chosen"),
        F.when(k % 30 != 0, "v1.0").alias("policy_version"),
        (k % 105).cast("double").alias("estimated_conversion"),
        F.size(F.when(k % 60 == 0, F.slice(every, 1, 4)).otherwise(every)).alias("n_estimates"),
        F.when(k % 70 == 0, 2).otherwise(F.col("reward")).alias("reward"),
        k.alias("record"),
    )


FAULTY = f"""{LOGS},
records AS (SELECT CASE WHEN event_id % 50 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 40 = 0 THEN 'unknown_offer' ELSE arm END AS arm_chosen,
  CASE WHEN event_id % 30 <> 0 THEN 'v1.0' END AS policy_version, event_id % 105 AS pct, CASE WHEN event_id % 60 = 0 THEN 4 ELSE 5 END AS n_estimates,
  CASE WHEN event_id % 70 = 0 THEN 2 ELSE reward END AS reward, event_id AS record FROM offer_log),
verdicts AS (SELECT record, event_id IS NOT NULL AS r1, arm_chosen <> 'unknown_offer' AS r2, policy_version IS NOT NULL AS r3, pct BETWEEN 0 AND 100 AS r4,
  n_estimates = 5 AS r5, reward IN (0, 1) AS r6 FROM records)"""
RULES = ["event_id_present", "arm_known", "version_present", "percent_in_range", "all_arms_estimated", "reward_binary"]


@query("record_rules", f"WITH {FAULTY} " + " UNION ALL ".join(
    f"SELECT '{name}' AS rule, count(*) AS checked, count(*) FILTER (r{i}) AS passed, count(*) FILTER (r{i}) / count(*) AS pass_rate FROM verdicts"
    for i, name in enumerate(RULES, start=1)))
def record_rules(spark, d):
    return B.rule_report(faulty_records(spark, d), B.decision_rules())


@query("record_quarantine", f"""
WITH {FAULTY} SELECT record, list_filter([{', '.join(f"CASE WHEN NOT r{i} THEN '{n}' END" for i, n in enumerate(RULES, start=1))}], lambda x: x IS NOT NULL) AS broken_rules
FROM verdicts WHERE NOT (r1 AND r2 AND r3 AND r4 AND r5 AND r6)""")
def record_quarantine(spark, d):
    return B.quarantine(faulty_records(spark, d), B.decision_rules())[1].select("record", "broken_rules")


@query("outcome_times", f"""
WITH {LOGS}, t AS (SELECT event_id, decided_at, reward, CAST(CASE WHEN reward = 1 THEN least(date_sub('day', decided_at, observed_at) + 1, 31) ELSE 30 END AS INTEGER) AS delay_days FROM offer_log)
SELECT event_id, decided_at, reward, delay_days, decided_at + to_days(delay_days) AS reward_observed_at, 30 AS horizon_days FROM t""")
def outcome_times(spark, d):
    joined = join_outcomes(decisions(spark, d), outcomes(spark, d), "event_id", "observed_at")
    rows = joined.select("event_id", "decided_at", "reward", "observed_at")
    return B.outcome_times(rows, "decided_at", "observed_at").drop("observed_at")


WINDOWS = f"""{LOGS},
w AS (SELECT CAST(floor(date_sub('day', (SELECT min(decided_at) FROM offer_log), decided_at) / 7) AS BIGINT) AS "window", count(reward) AS n_obs,
  CAST(sum(reward) AS BIGINT) AS n_conv FROM offer_log GROUP BY 1),
p AS (SELECT *, n_conv / n_obs AS rate, lag(n_conv / n_obs) OVER (ORDER BY "window") AS previous_rate FROM w),
windows AS (SELECT *, abs(rate - previous_rate) AS delta, coalesce(abs(rate - previous_rate) > 0.05, false) AS drift FROM p)"""


def drift_windows(spark, d):
    return D.outcome_drift(offer_log(spark, d), "decided_at", "reward")


@query("reward_drift", f"""WITH {WINDOWS} SELECT "window", n_obs, n_conv, rate, previous_rate, delta, drift FROM windows""")
def reward_drift(spark, d):
    return drift_windows(spark, d)


@query("reward_drift_summary", f"""
WITH {WINDOWS} SELECT bool_or(drift) AS drift_detected, coalesce(round(max(delta), 4), 0) AS max_delta, count(*) AS n_windows FROM windows""")
def reward_drift_summary(spark, d):
    return D.drift_summary(drift_windows(spark, d))


PSI_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]
CUT = "1998-01-01"


def _psi_sql(column: str) -> str:
    return f"""
{column}_q AS (SELECT list_sort(list_distinct(quantile_cont({column}::DOUBLE, {sql_list([round(i / 10, 1) for i in range(11)])}))) AS e FROM old),
{column}_b AS (SELECT side, CASE WHEN v > e[-1] OR v < e[1] THEN NULL ELSE least(len(list_filter(e, lambda x: x <= v)), len(e) - 1) END AS bin
  FROM (SELECT 'e' AS side, {column}::DOUBLE AS v FROM old UNION ALL SELECT 'a', {column} * 1.05 FROM fresh), {column}_q),
{column}_s AS (SELECT g.bin, count(*) FILTER (side = 'e') / (SELECT count(*) FROM old) AS es, count(*) FILTER (side = 'a') / (SELECT count(*) FROM fresh) AS sa
  FROM (SELECT unnest(range(1, len(e))) AS bin FROM {column}_q) g LEFT JOIN {column}_b b ON b.bin = g.bin GROUP BY 1),
{column}_p AS (SELECT '{column}' AS column_name, sum((x - y) * ln(x / y)) AS psi FROM (SELECT CASE WHEN es = 0 THEN 0.0001 ELSE es END AS y, CASE WHEN sa = 0 THEN 0.0001 ELSE sa END AS x FROM {column}_s))"""


PSI = f"""
old AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT}'), fresh AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUT}'),
{','.join(_psi_sql(c) for c in PSI_COLUMNS)},
raw_psi AS ({' UNION ALL '.join(f'SELECT * FROM {c}_p' for c in PSI_COLUMNS)}),
psi AS (SELECT column_name, round(psi, 4) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.2 THEN 'monitor' ELSE 'retrain' END AS status FROM raw_psi)"""


def psi(spark, d):
    lines = load(spark, d, "lineitem")
    cut = F.lit(datetime.fromisoformat(CUT)).cast("timestamp_ntz")
    shifted = {c: F.col(c) * 1.05 for c in PSI_COLUMNS}
    return D.feature_psi(
        lines.where(F.col("l_shipdate") < cut), lines.where(F.col("l_shipdate") >= cut).withColumns(shifted), PSI_COLUMNS
    )


@query("feature_psi", f"WITH {PSI} SELECT * FROM psi")
def feature_psi(spark, d):
    return psi(spark, d)


@query("retrain_decision", f"""
WITH {WINDOWS}, {PSI} SELECT (SELECT bool_or(drift) FROM windows) AS outcome_drift, (SELECT bool_or(status = 'retrain') FROM psi) AS feature_drift,
  (SELECT bool_or(drift) FROM windows) OR (SELECT bool_or(status = 'retrain') FROM psi) AS retrain""")
def retrain_decision(spark, d):
    return D.retrain_decision(drift_windows(spark, d), psi(spark, d))


@query("approval_gate", f"""
WITH {SCORED}, r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM scored),
a AS (SELECT round((sum(rk) FILTER (quality = 1) - (count(*) FILTER (quality = 1)) * (count(*) FILTER (quality = 1) + 1) / 2)
  / ((count(*) FILTER (quality = 1)) * (count(*) FILTER (quality = 0))), 6) AS auc FROM r),
c AS (SELECT 'distinct_share' AS version, auc FROM a UNION ALL SELECT 'reversed', round(1 - auc, 6) FROM a)
SELECT version, auc, 0.65::DOUBLE AS current_auc, round(auc - 0.65, 6) AS delta,
  CASE WHEN auc >= 0.6 AND auc - 0.65 >= -0.02 THEN 'approved' ELSE 'pending_human_approval' END AS status,
  CASE WHEN auc >= 0.6 AND auc - 0.65 >= -0.02 THEN 'auto_gate' END AS approved_by FROM c""")
def approval_gate(spark, d):
    rows = scored_labels(spark, d)
    first = area_under_roc(rows, "score", "quality").select(F.round("auc", 6).alias("auc"))
    candidates = first.select(F.lit("distinct_share").alias("version"), "auc").unionByName(
        first.select(F.lit("reversed").alias("version"), F.round(1 - F.col("auc"), 6).alias("auc"))
    )
    current = spark.createDataFrame([(0.65,)], "auc double")
    return D.approval_gate(candidates, current).withColumn("delta", F.round("delta", 6))


def version_log(spark, d):
    """A version log from the events: each event moves one of fifty versions."""
    status = F.when(F.col("event_type") == "purchase", "production").when(F.col("event_type") == "signup", "approved").otherwise("candidate")
    return load(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("v"), F.col("user_id") % 50).alias("version"), status.alias("status")
    )


VERSIONS = """
log AS (SELECT event_id AS seq, 'v' || user_id % 50 AS version, CASE event_type WHEN 'purchase' THEN 'production' WHEN 'signup' THEN 'approved' ELSE 'candidate' END AS status FROM events)"""
STATES = """
p AS (SELECT version, last(status ORDER BY seq) AS last_status, max(seq) FILTER (status = 'production') AS promoted FROM {0} GROUP BY 1),
states AS (SELECT version, CASE WHEN promoted = (SELECT max(promoted) FROM p) THEN 'production' WHEN promoted IS NOT NULL THEN 'retired' ELSE last_status END AS state,
  promoted IS NOT NULL AND promoted <> (SELECT max(promoted) FROM p) AS can_roll_back FROM p)"""


@query("version_state", f"WITH {VERSIONS}, {STATES.format('log')} SELECT * FROM states")
def version_state(spark, d):
    return D.version_states(version_log(spark, d))


@query("version_rollback", f"""
WITH {VERSIONS}, again AS (SELECT * FROM log UNION ALL SELECT (SELECT max(seq) + 1 FROM log), 'v7', 'production'
  WHERE (SELECT max(seq) FROM log WHERE status = 'production' AND version = 'v7') < (SELECT max(seq) FROM log WHERE status = 'production')),
{STATES.format('again')} SELECT * FROM states""")
def version_rollback(spark, d):
    return D.version_states(D.roll_back(version_log(spark, d), "v7"))


@query("encode_clients", f"""
WITH {CLIENTS} SELECT client, CAST(dense_rank() OVER (ORDER BY job) - 1 AS INTEGER) AS job, CAST(pdays <> -1 AS INTEGER) AS contacted_before,
  greatest(pdays, 0) AS pdays_clean, round((age - avg(age) OVER ()) / stddev_pop(age) OVER (), 6) AS age FROM clients""")
def encode_clients(spark, d):
    """The client features of the conversion model: codes, sentinel flag, z-score."""
    from tidewell.functions.columns import cleaned_days, contacted_flag

    rows = clients(spark, d)
    coded = E.encode(rows, E.category_codes(rows, "job", by="alphabet"), "job", "job_code")
    scaled = E.scale_population(coded.withColumn("age", F.col("age").cast("double")), ["age"])
    return scaled.select(
        "client", F.col("job_code").alias("job"), contacted_flag(F.col("pdays")).alias("contacted_before"),
        cleaned_days(F.col("pdays")).alias("pdays_clean"), F.round("age", 6).alias("age"),
    )
