"""Aggregates: counts, profiles, group statistics, histograms, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.columns import reais
from tidewell.operators.ordered import exact_quantiles
from tidewell.operators.quantiles import column_quantiles


def sum_of(value: Column, decimals: int | None = None) -> Column:
    """Sum; with ``decimals`` in fixed point, so it does not depend on the order of the rows.

    Fixed point is for columns that carry no more decimal places than that.
    """
    if decimals is None:
        return F.sum(value)
    return F.sum(value.cast(f"decimal(24,{decimals})")).cast("double")


def mean_of(value: Column, decimals: int | None = None) -> Column:
    """Mean; with ``decimals`` from a fixed-point sum."""
    return F.avg(value) if decimals is None else sum_of(value, decimals) / F.count(value)


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))


def _per_column(df: DataFrame, columns: Sequence[str], test, name: str) -> DataFrame:
    """One pass over the table, then one result row per column."""
    if not columns:
        return df.sparkSession.createDataFrame([], f"column_name string, {name} bigint")
    counts = df.agg(*(F.count_if(test(F.col(c))).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias(name)) for c in columns))
    return counts.select(F.inline(pairs))


def null_profile(df: DataFrame) -> DataFrame:
    return _per_column(df, df.columns, lambda c: c.isNull(), "null_count")


def literal_profile(df: DataFrame, literal: str = "unknown") -> DataFrame:
    """How often each text column holds the literal; columns without it are left out."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return _per_column(df, texts, lambda c: c == literal, "hits").where(F.col("hits") > 0)


def nan_profile(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return _per_column(df, floats, lambda c: c.isNull() | F.isnan(c), "missing")


def require_complete(df: DataFrame) -> DataFrame:
    """Raise and name the columns that hold null or NaN; otherwise hand the table on."""
    bad = [r["column_name"] for r in nan_profile(df).where(F.col("missing") > 0).collect()]
    if bad:
        raise ValueError(f"missing values in columns: {sorted(bad)}")
    return df


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def distinct_count(df: DataFrame, column: str, name: str = "n_distinct", rsd: float | None = None) -> DataFrame:
    """Exact count through a two-step aggregate, or approximate with a relative error."""
    if rsd:
        return df.agg(F.approx_count_distinct(column, rsd).alias(name))
    return df.where(F.col(column).isNotNull()).select(column).distinct().agg(F.count("*").alias(name))


def group_mean_median(df: DataFrame, key: str, value: str, decimals: int | None = None) -> DataFrame:
    means = df.groupBy(key).agg(mean_of(F.col(value), decimals).alias("mean"))
    return means.join(exact_quantiles(df, [key], value, {"median": 0.5}), key, "left")


def group_by_map(df: DataFrame, keys: Sequence[str], functions: Mapping[str, str]) -> DataFrame:
    """Aggregates named by a column -> function map, as ``function_column``."""
    return df.groupBy(*keys).agg(
        *(F.expr(f"{fn}(`{c}`)").alias(f"{fn}_{c}") for c, fn in functions.items())
    )


def ranked_groups(df: DataFrame, key: str, measure: Column, name: str) -> DataFrame:
    return df.groupBy(key).agg(measure.alias(name)).orderBy(F.desc(name), key)


def group_stats(df: DataFrame, keys: Sequence[str], value: str, decimals: int | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(mean_of(F.col(value), decimals).alias("mean"), F.count("*").alias("n"))


def describe_column(df: DataFrame, column: str) -> DataFrame:
    """Typed count, mean, sample deviation, minimum and maximum, one row each."""
    c = F.col(column).cast("double")
    stats = df.agg(
        F.count(c).cast("double").alias("count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("stddev"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )
    pairs = F.array(*(F.struct(F.lit(n).alias("statistic"), F.col(n).alias("value")) for n in stats.columns))
    return stats.select(F.inline(pairs))


def quantile(df: DataFrame, column: str, fraction: float, accuracy: int | None = None) -> DataFrame:
    """Exact interpolated quantile, or the approximate one with a given accuracy."""
    if accuracy:
        return df.agg(F.percentile_approx(column, fraction, accuracy).alias("quantile"))
    return column_quantiles(df, column, {"quantile": fraction})


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts of equal-width bins; the top edge falls in the last bin, outside values drop.

    Without a range the bins span minimum to maximum; a single value sits in the middle
    of a range of length 1.
    """
    value = F.col(column).cast("double")
    if low is None or high is None:
        span = df.agg(F.min(value).alias("_tw_lo"), F.max(value).alias("_tw_hi"))
        ranged = df.select(value.alias("_tw_v")).crossJoin(F.broadcast(span))
    else:
        ranged = df.select(
            value.alias("_tw_v"), F.lit(float(low)).alias("_tw_lo"), F.lit(float(high)).alias("_tw_hi")
        )
    point = F.col("_tw_lo") == F.col("_tw_hi")
    lo = F.when(point, F.col("_tw_lo") - 0.5).otherwise(F.col("_tw_lo"))
    hi = F.when(point, F.col("_tw_hi") + 0.5).otherwise(F.col("_tw_hi"))
    v = F.col("_tw_v")
    index = F.least(F.floor((v - lo) * bins / (hi - lo)), F.lit(bins - 1))
    placed = ranged.where((v >= lo) & (v <= hi)).withColumn("bin", index.cast("int"))
    return placed.groupBy("bin").agg(F.count("*").alias("n"))


def overview(df: DataFrame, price: str, rating: str, decimals: int | None = None) -> DataFrame:
    """Row count, mean price as currency text, and the rating distribution as JSON.

    Rows without a rating show as ``null`` with count 0, since the count is of ratings.
    """
    by_rating = df.groupBy(rating).agg(
        F.count("*").alias("rows"), F.count(rating).alias("n"),
        sum_of(F.col(price), decimals).alias("s"), F.count(price).alias("c"),
    )
    name = F.coalesce(F.col(rating).cast("string"), F.lit("null"))
    pairs = F.array_sort(F.collect_list(F.struct(name.alias("k"), F.col("n").alias("v"))))
    return by_rating.agg(
        F.sum("rows").alias("total"),
        reais(F.try_divide(F.sum("s"), F.sum("c"))).alias("mean_price"),
        F.to_json(F.map_from_entries(pairs)).alias("rating_distribution"),
    )


def category_stats(df: DataFrame, category: str, price: str, decimals: int | None = None) -> DataFrame:
    return df.groupBy(category).agg(
        F.count(category).alias("n"), F.round(mean_of(F.col(price), decimals), 2).alias("mean_price")
    )


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each group of equal rows."""
    return (
        df.groupBy(*columns).agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def group_rate(df: DataFrame, key: str, condition: Column, digits: int = 3) -> DataFrame:
    """Share of rows per group for which the condition holds."""
    rate = F.count_if(condition) / F.count("*")
    return df.groupBy(key).agg(F.round(rate, digits).alias("rate"))


def conditional_mean(df: DataFrame, value: str, condition: Column, decimals: int | None = None) -> DataFrame:
    """Mean over the rows that meet the condition, beside their share of all rows."""
    return df.agg(
        mean_of(F.when(condition, F.col(value)), decimals).alias("conditional_mean"),
        (F.count_if(condition) / F.count("*")).alias("rate"),
    )


def relative_error(df: DataFrame, predicted: Column, actual: Column, digits: int = 6) -> DataFrame:
    """Min, max, mean and population deviation of the error in percent; actual 0 is left out."""
    error = F.try_divide((predicted - actual) * 100, actual)
    return df.select(error.alias("_tw_e")).agg(
        *(
            F.round(fn("_tw_e"), digits).alias(name)
            for name, fn in (
                ("min_error", F.min), ("max_error", F.max), ("mean_error", F.avg), ("std_error", F.stddev_pop)
            )
        )
    )


def segment_fairness(df: DataFrame, segment: str, chosen: str, reward: str) -> DataFrame:
    """Exposure, conversion and exposure share per segment, and the conversion gap."""
    per = df.groupBy(segment).agg(
        F.count(chosen).alias("exposure"), F.round(F.sum(reward) / F.count(reward), 4).alias("conversion")
    )
    # one row per segment: a handful of rows for the whole-table window
    whole = Window.partitionBy()
    return per.select(
        segment,
        "exposure",
        "conversion",
        F.round(F.col("exposure") / F.sum("exposure").over(whole), 4).alias("exposure_share"),
        F.round(F.max("conversion").over(whole) - F.min("conversion").over(whole), 4).alias("conversion_gap"),
    )


def map_of_counts(df: DataFrame, column: str, name: str = "counts") -> DataFrame:
    """All group counts as one map value; meant for columns with few values."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(column).cast("string").alias("k"), F.col("n").alias("v"))))
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).agg(
        F.map_from_entries(pairs).alias(name)
    )
