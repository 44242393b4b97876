"""Offer experimentation over decision and outcome logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.sources.files import broadcast_if_small
from tidewell.functions.columns import SEGMENTS, clip, keyed_hash, standard_normal

# The offers, in list order (ties go to the earlier offer).
OFFERS = [
    # offer, channel, months, rate, segments with affinity, known conversion
    ("dep_6m_8pct", "app", 6, 0.08, ["A_reativacao_positiva", "C_alta_propensao"], 0.18),
    ("dep_12m_10pct", "email", 12, 0.10, ["A_reativacao_positiva", "B_reativacao_negativa"], 0.14),
    ("reativacao", "sms", 3, 0.07, ["A_reativacao_positiva"], 0.28),
    ("cashback", "app", 0, 0.02, ["C_alta_propensao", "E_cold_start_generico"], 0.09),
    ("previdencia", "email", 24, 0.06, ["C_alta_propensao", "D_comprometido_financeiramente"], 0.12),
]
# Name and description of each offer.
OFFER_TEXTS = {
    "dep_6m_8pct": ("Depósito 6m 8% a.a.", "Depósito de curto prazo com rentabilidade atrativa"),
    "dep_12m_10pct": ("Depósito 12m 10% a.a.", "Depósito de médio prazo com taxa competitiva"),
    "reativacao": ("Oferta de Reativação", "Oferta personalizada para clientes com histórico positivo"),
    "cashback": ("Cashback no débito", "Benefício imediato para novos engajamentos"),
    "previdencia": ("Previdência Privada", "Produto de longo prazo para planejamento financeiro"),
}
SEGMENT_MULTIPLIERS = {
    "A_reativacao_positiva": 2.0,
    "B_reativacao_negativa": 0.5,
    "C_alta_propensao": 1.3,
    "D_comprometido_financeiramente": 0.7,
    "E_cold_start_generico": 1.0,
}
DEFAULT_RATE = 0.10
AFFINITY_BONUS = 0.3
HORIZON_DAYS = 30
# Segment, expected offer and kind of each golden case, then why, in the same order.
GOLDEN_TEMPLATES = [
    ("A_reativacao_positiva", "reativacao", "typical"),
    ("A_reativacao_positiva", "dep_6m_8pct", "typical"),
    ("C_alta_propensao", "dep_6m_8pct", "typical"),
    ("E_cold_start_generico", "cashback", "edge"),
    ("D_comprometido_financeiramente", "cashback", "edge"),
    ("B_reativacao_negativa", "cashback", "adversarial"),
    ("E_cold_start_generico", "previdencia", "adversarial"),
]
GOLDEN_REASONS = [
    "Cliente com histórico positivo deve receber oferta de reativação",
    "Alternativa válida para reativação positiva",
    "Estudante/aposentado: alta propensão para depósito curto",
    "Cold-start: oferta de baixo compromisso para engajamento inicial",
    "Cliente endividado: não deve receber produtos de alto valor",
    "Reativação negativa: oferta simples para reconquistar",
    "Cold-start NÃO deve receber previdência — produto de longo prazo",
]
RANDOM_REASON = "Caso gerado automaticamente do histórico de eventos"
RANDOM_PASS, RANDOM_FAIL = "reward >= reward_expected", "reward = 0 E arm_expected tem alta taxa histórica"
ARMS = [offer[0] for offer in OFFERS]
KNOWN_RATES = {offer[0]: offer[5] for offer in OFFERS}
BEST_ARM = max(ARMS, key=KNOWN_RATES.get)

OFFER_SCHEMA = (
    "position int, offer_id string, channel string, duration_months int, rate double, "
    "segment_affinity array<string>, base_conversion_rate double, name string, description string"
)


def offer_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *offer, *OFFER_TEXTS[offer[0]]) for i, offer in enumerate(OFFERS)], OFFER_SCHEMA)


def with_rounds(offers: DataFrame, rounds: DataFrame) -> DataFrame:
    """Every offer with its ``rounds`` (offer_id, rounds); an offer that was never shown has 0."""
    return offers.join(rounds, "offer_id", "left").withColumn("rounds", F.coalesce("rounds", F.lit(0).cast("bigint")))


def check_context(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds the names of missing features; a row is valid when there are none."""
    named = [
        F.when(F.col(f).isNull() if f in df.columns else F.lit(True), F.lit(f)) for f in features
    ]
    missing = F.array_compact(F.array(*named))
    return df.withColumn("missing", missing).withColumn("valid", F.size("missing") == 0)


def posterior_estimates(log: DataFrame, segment: str, arm: str, reward: str) -> DataFrame:
    """Mean and deviation of the Beta(1 + hits, 1 + misses) posterior, every segment x offer."""
    spark = log.sparkSession
    grid = spark.createDataFrame(
        [(s, i, a) for s in SEGMENTS for i, a in enumerate(ARMS)], "segment string, position int, arm string"
    )
    counts = log.groupBy(F.col(segment).alias("segment"), F.col(arm).alias("arm")).agg(
        F.count_if(F.col(reward) == 1).alias("hits"), F.count_if(F.col(reward) == 0).alias("misses")
    )
    filled = grid.join(counts, ["segment", "arm"], "left").fillna({"hits": 0, "misses": 0})
    a, b = F.col("hits") + 1.0, F.col("misses") + 1.0
    return filled.select(
        "segment", "position", "arm", "hits", "misses",
        (a / (a + b)).alias("mean"),
        F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1.0))).alias("std"),
    )


def estimates_by_segment(estimates: DataFrame) -> DataFrame:
    """One row per segment with its estimates in offer order (5 rows, safe to broadcast)."""
    return estimates.groupBy("segment").agg(
        F.array_sort(F.collect_list(F.struct("position", "arm", "mean", "std"))).alias("_tw_estimates")
    )


def thompson_choose(
    clients: DataFrame, key: str, segment: str, estimates: DataFrame, version: str = "v1.0", seed: int = 42
) -> DataFrame:
    """Sampled choice per client, with reason codes and the estimates of all offers.

    All offers of a client are compared inside its row: no expansion to client x offer
    rows and no shuffle. Estimates are frozen for the batch.
    """
    known = clients.join(
        F.broadcast(estimates_by_segment(estimates).withColumnRenamed("segment", segment)), segment, "left"
    )
    options = []
    for i, arm in enumerate(ARMS):
        estimate = F.get(F.col("_tw_estimates"), F.lit(i))
        noise = standard_normal(F.col(key), F.lit(arm), seed=seed)
        sample = clip(estimate["mean"] + F.greatest(estimate["std"], F.lit(1e-4)) * noise, 0.0, 1.0)
        options.append(
            F.struct(
                sample.alias("sample"), F.lit(-i).alias("rank"), F.lit(arm).alias("arm"),
                estimate["mean"].alias("mean"), estimate["std"].alias("std"),
            )
        )
    chosen = known.withColumn("_tw_best", F.array_max(F.array(*options)))
    return chosen.select(
        *clients.columns,
        F.col("_tw_best.arm").alias("arm_chosen"),
        F.lit(version).alias("policy_version"),
        F.round(F.col("_tw_best.mean") * 100, 2).alias("estimated_conversion"),
        F.round("_tw_best.std", 4).alias("uncertainty_std"),
        (F.col("_tw_best.std") > 0.05).alias("exploring"),
        F.round("_tw_best.sample", 4).alias("ts_sample"),
        F.transform(
            "_tw_estimates",
            lambda e: F.struct(e["arm"].alias("arm"), F.round(e["mean"], 6).alias("mean"), F.round(e["std"], 6).alias("std")),
        ).alias("estimates"),
    )


def baseline_choose(clients: DataFrame) -> DataFrame:
    """Always the offer with the best known rate."""
    return clients.withColumns(
        {"arm_chosen": F.lit(BEST_ARM), "known_rate": F.lit(KNOWN_RATES[BEST_ARM])}
    )


def best_offer(pairs: DataFrame, keys: Sequence[str], arm: str, value: str, position: str) -> DataFrame:
    """Offer with the highest value per group; a tie goes to the earlier offer."""
    lot = F.struct(F.col(value), -F.col(position))
    return pairs.groupBy(*keys).agg(F.max_by(arm, lot).alias("best_arm"), F.max(value).alias("best_value"))


def offer_propensity(clients: DataFrame, segment: str, offers: DataFrame) -> DataFrame:
    """Probability of each offer: 1, plus a bonus where the segment has affinity, normalised.

    An unknown or missing segment has affinity to none, so all its offers are equally likely. The
    normaliser is worked out per segment on the fixed offers, so clients are expanded without a shuffle.
    """
    spark = clients.sparkSession
    segments = spark.createDataFrame([(s,) for s in SEGMENTS], "_tw_segment string")
    weighted = segments.crossJoin(F.broadcast(offers)).withColumn(
        "_tw_w",
        1.0 + F.when(F.array_contains("segment_affinity", F.col("_tw_segment")), AFFINITY_BONUS).otherwise(0.0),
    )
    sums = weighted.groupBy("_tw_segment").agg(F.sum("_tw_w").alias("_tw_sum"))
    table = weighted.join(sums, "_tw_segment").groupBy("_tw_segment").agg(
        F.collect_list(F.struct("offer_id", (F.col("_tw_w") / F.col("_tw_sum")).alias("propensity"))).alias("_tw_own")
    )
    count = F.size(F.collect_list("offer_id"))
    even = offers.agg(
        F.transform(F.collect_list("offer_id"), lambda o: F.struct(o.alias("offer_id"), F.lit(0.0).alias("propensity"))).alias("_tw_ids"),
        (1.0 / count).alias("_tw_share"),
    )
    # one row for each known segment, and one row
    known = clients.join(F.broadcast(table), F.col(segment) == F.col("_tw_segment"), "left").crossJoin(F.broadcast(even))
    equal = F.transform("_tw_ids", lambda o: F.struct(o["offer_id"].alias("offer_id"), F.col("_tw_share").alias("propensity")))
    return known.select(*clients.columns, F.inline(F.coalesce("_tw_own", equal)))


def policy_metrics(log: DataFrame, arm: str, reward: str, by: Sequence[str] = ()) -> DataFrame:
    """Rounds, reward, conversion, regret, exploration share, and offer maps as JSON.

    Regret of a round is the best known rate less the reward; a round explores when it
    does not choose the best known offer.
    """
    best_rate = KNOWN_RATES[BEST_ARM]
    per_arm = log.groupBy(*by, F.col(arm).alias("_tw_arm")).agg(
        F.count("*").alias("n"), F.sum(F.col(reward).cast("bigint")).alias("r")
    )

    def pair(value: Column) -> Column:
        entry = F.when(F.col("_tw_arm").isNotNull(), F.struct(F.col("_tw_arm"), value))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    return per_arm.groupBy(*by).agg(
        F.sum("n").alias("total_rounds"),
        F.sum("r").alias("total_reward"),
        F.round(F.sum("r") / F.sum("n"), 4).alias("conversion_rate"),
        F.round(F.sum("n") * best_rate - F.sum("r"), 2).alias("cumulative_regret"),
        F.round(F.sum(F.when(F.col("_tw_arm") != BEST_ARM, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias(
            "exploration_rate"
        ),
        F.to_json(pair(F.col("n"))).alias("arm_counts"),
        F.to_json(pair(F.round(F.col("r") / F.col("n"), 4))).alias("arm_rates"),
    )


def conversion_probability(df: DataFrame, arm: str, segment: str, name: str = "conversion_probability") -> DataFrame:
    """Known rate of the offer times the segment's multiplier, within [0.02, 0.90]."""

    def fixed(table: Mapping[str, float], column: str, default: float) -> Column:
        entries = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
        return F.coalesce(F.try_element_at(entries, F.col(column)), F.lit(default))

    raw = fixed(KNOWN_RATES, arm, DEFAULT_RATE) * fixed(SEGMENT_MULTIPLIERS, segment, 1.0)
    return df.withColumn(name, clip(raw, 0.02, 0.90))


def golden_select(log: DataFrame, key: str, segment: str, arm: str, reward: str, n: int = 30, seed: int = 42) -> DataFrame:
    """Golden cases: one repeatable pick per template, then random rows up to n.

    A template whose segment has no rows is left out. Random cases expect the logged
    offer. Cases are numbered in that order and carry the reason and the criteria to judge them by.
    """
    spark = log.sparkSession
    templates = spark.createDataFrame(
        [(i, *t, why) for i, (t, why) in enumerate(zip(GOLDEN_TEMPLATES, GOLDEN_REASONS), start=1)],
        "template int, _tw_segment string, arm_expected string, case_type string, justification string",
    )
    row = F.struct(key, segment, reward)
    lot = F.struct(F.md5(F.concat_ws("|", F.col(key).cast("string"), (F.lit(seed) + F.col("template")).cast("string"))), F.col(key))
    # an offer expected with a rate above 12% is expected to convert
    rates = F.create_map(*(F.lit(x) for pair in KNOWN_RATES.items() for x in pair))
    picked = (
        log.join(F.broadcast(templates), F.col(segment) == F.col("_tw_segment"))
        .groupBy("template", "arm_expected", "case_type", "justification")
        .agg(F.min_by(row, lot).alias("_tw"))
        .select(
            "template", "case_type", F.col(f"_tw.{key}").alias(key), F.col(f"_tw.{segment}").alias("segment"),
            "arm_expected", (F.try_element_at(rates, F.col("arm_expected")) > 0.12).cast("int").alias("reward_expected"),
            "justification",
            F.format_string('arm_chosen == "%s" OU conversion_rate > 0.12', "arm_expected").alias("pass_criteria"),
            F.concat(F.lit("arm_chosen em braços com afinidade zero para "), F.col(f"_tw.{segment}")).alias("fail_criteria"),
            F.lit("").alias("_tw_lot"),
        )
    )
    fill = (
        log.withColumn("_tw_lot", keyed_hash(F.col(key), seed=seed)).orderBy("_tw_lot", key).limit(n)
        .select(
            F.lit(len(GOLDEN_TEMPLATES) + 1).alias("template"), F.lit("random").alias("case_type"), key,
            F.col(segment).alias("segment"), F.col(arm).alias("arm_expected"),
            F.col(reward).cast("int").alias("reward_expected"), F.lit(RANDOM_REASON).alias("justification"),
            F.lit(RANDOM_PASS).alias("pass_criteria"), F.lit(RANDOM_FAIL).alias("fail_criteria"), "_tw_lot",
        )
    )
    cases = picked.unionByName(fill).orderBy("template", "_tw_lot", key).limit(n)
    number = F.row_number().over(Window.orderBy("template", "_tw_lot", key))  # of n cases
    return cases.select(F.format_string("GS_%03d", number).alias("case_id"), "*").drop("_tw_lot", "template")


def golden_evaluate(cases: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Per case: passed when the offer is the expected one or the estimate exceeds 5 percent.

    A case without a decision fails with the reason. Of several decisions for a case the one with the
    highest estimate counts. The cases are few, so the decisions are reduced to theirs before any shuffle.
    """
    own = decisions.join(broadcast_if_small(cases.select(key).distinct()), key, "left_semi")
    single = own.groupBy(key).agg(
        F.max_by(F.struct("arm_chosen", "estimated_conversion"), F.struct("estimated_conversion", "arm_chosen")).alias("_tw")
    )
    joined = cases.join(single.select(key, "_tw.*"), key, "left")
    right = F.col("arm_chosen") == F.col("arm_expected")
    return joined.withColumn(
        "passed", F.coalesce(right | (F.col("estimated_conversion") > 5.0), F.lit(False))
    ).withColumn("error", F.when(F.col("arm_chosen").isNull(), F.lit("no decision")))


def pass_rates(evaluated: DataFrame, kind: str) -> DataFrame:
    """Pass rate per kind of case and over all cases (kind 'all')."""
    per = evaluated.groupBy(F.col(kind).alias("kind")).agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passes")
    )
    total = per.agg(F.lit("all").alias("kind"), F.sum("cases").alias("cases"), F.sum("passes").alias("passes"))
    return per.unionByName(total).withColumn("pass_rate", F.round(F.try_divide("passes", "cases"), 3))


def rule_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Checked and passed rows per rule, in one pass; a null verdict does not pass."""
    checked = df.agg(
        F.count("*").alias("_tw_n"),
        *(F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()),
    )
    entries = F.array(
        *(F.struct(F.lit(n).alias("rule"), F.col("_tw_n").alias("checked"), F.col(n).alias("passed")) for n in rules)
    )
    return checked.select(F.inline(entries)).withColumn("pass_rate", F.try_divide("passed", "checked"))


def quarantine(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet every rule, and the others with the names of the broken rules."""
    broken = F.array_compact(
        F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))
    )
    judged = df.withColumn("broken_rules", broken)
    return judged.where(F.size("broken_rules") == 0).drop("broken_rules"), judged.where(F.size("broken_rules") > 0)


def decision_rules() -> dict[str, Column]:
    """The rules a decision or reward record has to meet."""
    return {
        "event_id_present": F.col("event_id").isNotNull(),
        "arm_known": F.col("arm_chosen").isin(*ARMS),
        "version_present": F.col("policy_version").isNotNull(),
        "percent_in_range": F.col("estimated_conversion").between(0, 100),
        "all_arms_estimated": F.col("n_estimates") == len(ARMS),
        "reward_binary": F.col("reward").isin(0, 1),
    }


def outcome_times(joined: DataFrame, decided: str, observed: str, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """Reward, delay and observation time; without a conversion that is the horizon's end.

    The delay counts started days, from 1 to horizon + 1.
    """
    converted = F.col("reward") == 1
    days = F.timestamp_diff("DAY", F.col(decided), F.col(observed)) + 1
    delay = F.when(converted, F.least(days, F.lit(horizon_days + 1))).otherwise(F.lit(horizon_days)).cast("int")
    out = joined.withColumn("delay_days", delay)
    return out.withColumns(
        {
            "reward_observed_at": F.col(decided) + F.make_dt_interval(F.col("delay_days")),
            "horizon_days": F.lit(horizon_days),
        }
    )


def run_report(metrics: DataFrame, fields: Sequence[str], name: str = "report") -> DataFrame:
    """All aggregates of a run as one JSON document per row."""
    return metrics.select(F.to_json(F.struct(*fields)).alias(name))


