"""Drift, approval and versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import drift_status, window_number
from tidewell.operators.quantiles import Quantiles, quantiles_of
from tidewell.operators.windows import change_flag

# Fixed values.
DRIFT_THRESHOLD = 0.05
MIN_AUC = 0.60
MAX_DROP = 0.02
EMPTY_SHARE = 1e-4


def outcome_drift(rewards: DataFrame, observed: str, reward: str, window_days: int = 7) -> DataFrame:
    """Rate per window counted from the earliest observation, against the previous existing window."""
    first = rewards.agg(F.min(observed).alias("_tw_first"))
    placed = rewards.crossJoin(F.broadcast(first)).withColumn(
        "window", window_number(F.col(observed), F.col("_tw_first"), window_days)
    )
    per = placed.groupBy("window").agg(
        F.count(reward).alias("n_obs"), F.sum(F.col(reward).cast("bigint")).alias("n_conv")
    ).withColumn("rate", F.col("n_conv") / F.col("n_obs"))
    # one row per calendar window from here on
    return change_flag(per, "window", "rate", DRIFT_THRESHOLD).withColumnsRenamed(
        {"previous": "previous_rate", "changed": "drift"}
    )


def drift_summary(windows: DataFrame) -> DataFrame:
    return windows.agg(
        F.bool_or("drift").alias("drift_detected"),
        F.coalesce(F.round(F.max("delta"), 4), F.lit(0.0)).alias("max_delta"),
        F.count("*").alias("n_windows"),
    )


def _bins(found: Quantiles) -> tuple[list[float], list[int]]:
    """Distinct edges, and the rows of the expected side in each bin; the last bin is closed."""
    edges, below = [], []
    for level, n in zip(found.levels, found.below):
        if level is not None and (not edges or level != edges[-1]):
            edges.append(level)
            below.append(n)
    return edges, [b - a for a, b in zip(below, [*below[1:-1], found.n])] if len(edges) > 1 else []


def feature_psi(expected: DataFrame, recent: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Population Stability Index of every column.

    Bin edges are quantiles of the expected rows with repeated edges merged, the last
    bin is closed, and values outside stay out of the bins but count in the share. A
    single edge gives 0. The quantiles also tell how many expected rows lie in each bin, so the expected side is read twice,
    the recent one once, with all columns beside each other and the edges as constants. NaN is refused.
    """
    spark = expected.sparkSession
    found = quantiles_of(expected, columns, [i / bins for i in range(bins + 1)])
    if found is None:
        raise ValueError("NaN in a monitored column")
    placed = {c: _bins(q) for c, q in found.items()}
    counts = []
    for at, (c, (edges, _)) in enumerate(placed.items()):
        v = F.col(c).cast("double")
        counts.append(F.count(v).alias(f"n{at}"))
        for b, (low, high) in enumerate(zip(edges, edges[1:])):
            inside = (v >= low) & ((v <= high) if b == len(edges) - 2 else (v < high))
            counts.append(F.count_if(inside).alias(f"n{at}_{b}"))
    seen = recent.agg(*counts).first()
    # as many rows as columns were listed, times the bins
    rows = [
        (c, b + 1, len(edges), own[b] if own else 0, found[c].n, seen[f"n{at}_{b}"] if own else 0, seen[f"n{at}"])
        for at, (c, (edges, own)) in enumerate(placed.items()) for b in range(max(1, len(own)))
    ]
    counted = spark.createDataFrame(rows, "column_name string, bin int, n_edges int, e bigint, all_e bigint, a bigint, all_a bigint")
    share_e, share_a = F.coalesce(F.try_divide("e", "all_e"), F.lit(0.0)), F.coalesce(F.try_divide("a", "all_a"), F.lit(0.0))
    e, a = F.when(share_e == 0, EMPTY_SHARE).otherwise(share_e), F.when(share_a == 0, EMPTY_SHARE).otherwise(share_a)
    term = F.when(F.col("n_edges") < 2, 0.0).otherwise((a - e) * F.log(a / e))
    scored = counted.groupBy("column_name").agg(F.sum(term).alias("_tw_psi"))
    return scored.select(
        "column_name", F.round("_tw_psi", 4).alias("psi"), drift_status(F.col("_tw_psi")).alias("status")
    )


def retrain_decision(windows: DataFrame, psi: DataFrame) -> DataFrame:
    """Retrain on any outcome drift or any column that asks for it."""
    outcome = windows.agg(F.coalesce(F.bool_or("drift"), F.lit(False)).alias("outcome_drift"))
    feature = psi.agg(F.coalesce(F.bool_or(F.col("status") == "retrain"), F.lit(False)).alias("feature_drift"))
    return outcome.crossJoin(feature).withColumn("retrain", F.col("outcome_drift") | F.col("feature_drift"))


def approval_gate(candidates: DataFrame, current: DataFrame, golden_rate: Column | None = None) -> DataFrame:
    """Approve candidates that reach the floor and do not fall behind the current model.

    ``candidates`` has (version, auc), ``current`` at most one row (auc). Without a
    current value the difference counts as 0. ``golden_rate`` adds the optional
    criterion that every golden case passes.
    """
    now = current.agg(F.max("auc").alias("current_auc"))
    judged = candidates.crossJoin(F.broadcast(now)).withColumn(
        "delta", F.coalesce(F.col("auc") - F.col("current_auc"), F.lit(0.0))
    )
    good = (F.col("auc") >= MIN_AUC) & (F.col("delta") >= -MAX_DROP)
    if golden_rate is not None:
        good = good & (golden_rate >= 1.0)
    good = F.coalesce(good, F.lit(False))
    return judged.withColumns(
        {
            "status": F.when(good, "approved").otherwise("pending_human_approval"),
            "approved_by": F.when(good, "auto_gate"),
        }
    )


def version_states(log: DataFrame) -> DataFrame:
    """Latest status of every version, from an append-only log (seq, version, status).

    The last promoted version is in production; a version promoted before it can be
    rolled back to.
    """
    per = log.groupBy("version").agg(
        F.max_by("status", "seq").alias("last_status"),
        F.max(F.when(F.col("status") == "production", F.col("seq"))).alias("promoted_at"),
    )
    newest = log.where(F.col("status") == "production").agg(F.max("seq").alias("_tw_newest"))
    joined = per.crossJoin(F.broadcast(newest))
    in_use = F.coalesce(F.col("promoted_at") == F.col("_tw_newest"), F.lit(False))
    return joined.select(
        "version",
        F.when(in_use, "production")
        .when(F.col("promoted_at").isNotNull(), "retired")
        .otherwise(F.col("last_status")).alias("state"),
        (F.col("promoted_at").isNotNull() & ~in_use).alias("can_roll_back"),
    )


def roll_back(log: DataFrame, target: str) -> DataFrame:
    """The log with a renewed promotion of ``target``; unchanged when it was never in production."""
    last = log.agg(F.max("seq").alias("_tw_last"))
    entry = (
        version_states(log).where((F.col("version") == target) & F.col("can_roll_back"))
        .crossJoin(F.broadcast(last))
        .select((F.col("_tw_last") + 1).cast(log.schema["seq"].dataType).alias("seq"), "version", F.lit("production").alias("status"))
    )
    return log.select("seq", "version", "status").unionByName(entry)
