"""Exact evaluation metrics over scored tables.

Rows are grouped by score before anything is ordered, and the running counts go
through range partitions, so neither ties nor table size end up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.ordered import running_sums


def _by_score(df: DataFrame, score: str, label: str, descending: bool) -> DataFrame:
    grouped = df.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.count("*").alias("n")
    )
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    order = F.desc("score") if descending else F.asc("score")
    return running_sums(
        grouped, [], [order], {"tp": pos, "fp": neg}, {"all_pos": pos, "all_neg": neg}
    )


def area_under_roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Share of (positive, negative) pairs ordered rightly; a tie counts half."""
    ranked = _by_score(df, score, label, descending=False)
    neg_here = F.col("n") - F.col("pos")
    won = F.col("pos") * (F.col("fp") - neg_here / 2)
    return ranked.agg(
        F.try_divide(
            F.sum(won.cast("decimal(28,1)")).cast("double"),
            F.max("all_pos").cast("double") * F.max("all_neg").cast("double"),
        ).alias("auc")
    )


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Sum over score levels of precision times the recall gained there."""
    ranked = _by_score(df, score, label, descending=True)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return ranked.agg(
        F.sum(precision * F.try_divide(F.col("pos"), F.col("all_pos"))).alias("average_precision")
    )


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """True and false positive rate at every score level used as a threshold."""
    ranked = _by_score(df, score, label, descending=True)
    return ranked.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp"), F.col("all_neg")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("all_pos")).alias("tpr"),
    )


def regression_errors(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    gap = F.col(predicted) - F.col(actual)
    return df.agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse")
    )


def accuracy(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    hit = F.col(predicted).cast("double") == F.col(actual).cast("double")
    return df.agg((F.count_if(hit) / F.count("*")).alias("accuracy"))
