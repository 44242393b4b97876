"""Series operators: bars, expanding means, lags, leads, look-back and splits.

Operators on bars (one row per series and day) use plain windows: a series has at
most one row per day, whatever the number of ticks. Operators on raw rows go
through ``ordered``, which splits large groups; ``ranges=True`` asks for that where both are possible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.aggregates import mean_of
from tidewell.operators.joins import with_group_stats
from tidewell.operators.ordered import last_known, last_n, number_rows, running_sums, with_halo


def daily_bars(ticks: DataFrame, series: str, moment: str, value: str, tie: str) -> DataFrame:
    """Open, high, low, close and volume per series and day, combined before the shuffle."""
    first = F.struct(F.col(moment), F.col(tie))
    return ticks.groupBy(F.col(series).alias("series"), F.to_date(moment).alias("day")).agg(
        F.min_by(value, first).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, first).alias("close"),
        F.count(value).alias("volume"),
    )


def expanding_mean(
    bars: DataFrame, series: str, order: str, value: str, name: str, digits: int | None = 2, decimals: int | None = None,
    ranges: bool = False, tie: str | None = None,
) -> DataFrame:
    """Mean of everything up to and including the row.

    ``ranges`` carries (sum, count) from range to range, so a series of any length spreads over many tasks; rows that ``order`` does not tell apart need a ``tie``.
    """
    if ranges:
        amount = F.col(value) if decimals is None else F.col(value).cast(f"decimal(24,{decimals})")
        sums = {"_tw_sum": amount, "_tw_count": F.col(value).isNotNull().cast("bigint")}
        placed = running_sums(bars, [series], [F.col(c) for c in (order, tie) if c], sums)
        mean = F.try_divide(F.col("_tw_sum").cast("double"), F.col("_tw_count"))
        return placed.withColumn(name, mean if digits is None else F.round(mean, digits)).drop("_tw_sum", "_tw_count")
    frame = Window.partitionBy(series).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if decimals is None:
        mean = F.avg(value).over(frame)
    else:
        fixed = F.col(value).cast(f"decimal(24,{decimals})")
        mean = F.sum(fixed).over(frame).cast("double") / F.count(value).over(frame)
    return bars.withColumn(name, mean if digits is None else F.round(mean, digits))


def fill_with_group_mean(df: DataFrame, key: str, value: str, decimals: int | None = None) -> DataFrame:
    """Nulls take the mean of their group. The mean is aggregated and joined back,
    so no group has to fit one task as it would in a partition window."""
    filled = with_group_stats(df, [key], {"_tw_mean": mean_of(F.col(value), decimals)})
    return filled.withColumn(value, F.coalesce(F.col(value), F.col("_tw_mean"))).drop("_tw_mean")


def fill_with_group_floor(df: DataFrame, key: str, value: str, decimals: int | None = None) -> DataFrame:
    """Nulls take the floor of their group's mean."""
    filled = with_group_stats(df, [key], {"_tw_mean": mean_of(F.col(value), decimals)})
    floor = F.floor("_tw_mean").cast(df.schema[value].dataType)
    return filled.withColumn(value, F.coalesce(F.col(value), floor)).drop("_tw_mean")


def fill_with_group_int(df: DataFrame, key: str, value: str, decimals: int | None = None) -> DataFrame:
    """Nulls take their group's mean; the whole column is truncated to integers."""
    return fill_with_group_mean(df, key, value, decimals).withColumn(value, F.col(value).cast("int"))


def _series_frame(df, series, order, before, after, block_rows):
    if block_rows is None:
        return df, [series]
    return with_halo(df, [series], [F.col(order)], block_rows, before, after)


def lag_matrix(
    bars: DataFrame, series: str, order: str, columns: Sequence[str], steps: int, block_rows: int | None = None
) -> DataFrame:
    """Lags ``steps``..1 of every column; rows with an incomplete history are dropped.

    ``block_rows`` cuts long series into overlapping blocks of that many rows.
    """
    framed, split = _series_frame(bars, series, order, steps, 0, block_rows)
    window = Window.partitionBy(*split).orderBy(order)
    lags = {f"{c}_lag{i}": F.lag(c, i).over(window) for i in range(steps, 0, -1) for c in columns}
    position = {} if block_rows else {"_tw_rn": F.row_number().over(window)}
    out = framed.withColumns({**lags, **position}).where(F.col("_tw_rn") > steps)
    if block_rows:
        out = out.where("_tw_own")
    return out.select(*bars.columns, *lags)


def lead_targets(
    bars: DataFrame, series: str, order: str, value: str, horizon: int, block_rows: int | None = None
) -> DataFrame:
    """The next ``horizon`` values, starting one step ahead; rows without them all are dropped."""
    framed, split = _series_frame(bars, series, order, 0, horizon, block_rows)
    window = Window.partitionBy(*split).orderBy(order)
    leads = {f"{value}_lead{j}": F.lead(value, j).over(window) for j in range(1, horizon + 1)}
    reached = F.lead(F.lit(True), horizon).over(window)
    out = framed.withColumns({**leads, "_tw_full": reached}).where(F.col("_tw_full").isNotNull())
    if block_rows:
        out = out.where("_tw_own")
    return out.select(*bars.columns, *leads)


def change_flag(rows: DataFrame, order: str, value: str, threshold: float, series: str | None = None) -> DataFrame:
    """Previous value, absolute change and whether it exceeds the threshold (false on the first row)."""
    window = Window.partitionBy(*([series] if series else [])).orderBy(order)
    previous = F.lag(value).over(window)
    return (
        rows.withColumn("previous", previous)
        .withColumn("delta", F.abs(F.col(value) - F.col("previous")))
        .withColumn("changed", F.coalesce(F.col("delta") > threshold, F.lit(False)))
    )


def running_total(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    return running_sums(rows, keys, [F.col(c) for c in order], {name: value})


def running_count(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    return number_rows(rows, keys, [F.col(c) for c in order], name)


def carry_forward(
    bars: DataFrame, series: str, order: str, column: str, ranges: bool = False, tie: str | None = None
) -> DataFrame:
    """Nulls take the last known value of the series; with ``ranges`` also for series too long for a task."""
    if ranges:
        return last_known(bars, [series], [F.col(c) for c in (order, tie) if c], {column: column})
    window = Window.partitionBy(series).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn(column, F.last(column, ignorenulls=True).over(window))


def every_day(bars: DataFrame, series: str, day: str, start=None, end=None) -> DataFrame:
    """One row per series and calendar day from its first to its last, gaps as nulls."""
    span = bars.groupBy(series).agg(F.min(day).alias("_tw_a"), F.max(day).alias("_tw_b"))
    first = F.lit(start) if start is not None else F.col("_tw_a")
    last = F.lit(end) if end is not None else F.col("_tw_b")
    days = span.select(series, F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias(day))
    return days.join(bars, [series, day], "left")


def look_back(
    bars: DataFrame, series: str, day: str, columns: Sequence[str], reference, n: int, ranges: bool = False, tie: str | None = None
) -> DataFrame:
    """Exactly n rows ending at the reference date as one array per column.

    A shorter history repeats its last row at the end. With ``ranges`` each range of a long series hands on its last n rows only.
    """
    if n <= 0:
        raise ValueError("look-back must be positive")
    order = [c for c in (day, tie) if c]
    newest = Window.partitionBy(series).orderBy(*(F.desc(c) for c in order))
    past = bars.where(F.col(day) <= F.lit(reference))
    if ranges:
        past = last_n(past, [series], [F.col(c) for c in order], n)
    kept = (
        past.withColumn("_tw_rn", F.row_number().over(newest))
        .where(F.col("_tw_rn") <= n)
    )
    rows = kept.groupBy(series).agg(
        F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order)))).alias("_tw_rows")
    )
    padded = F.concat(
        F.col("_tw_rows"), F.array_repeat(F.element_at("_tw_rows", -1), F.lit(n) - F.size("_tw_rows"))
    )
    return rows.withColumn("_tw_rows", padded).select(
        series, *(F.col(f"_tw_rows.{c}").alias(c) for c in columns)
    )


def chronological_split(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], fractions: Sequence[tuple[str, float]]
) -> DataFrame:
    """Label rows by position: the first share of each group, then the next, and so on."""
    placed = number_rows(rows, keys, [F.col(c) for c in order], "_tw_rn", total="_tw_n")
    label = F.lit(fractions[-1][0])
    edge = round(sum(f for _, f in fractions[:-1]), 9)
    for name, share in reversed(fractions[:-1]):
        label = F.when(F.col("_tw_rn") <= F.floor(F.col("_tw_n") * F.lit(edge)), name).otherwise(label)
        edge = round(edge - share, 9)
    return placed.withColumn("part", label).drop("_tw_rn", "_tw_n")
