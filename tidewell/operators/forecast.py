"""Multi-step forecasts of daily series from lags of price and volume."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.moments import moments
from tidewell.operators.moments import ridge as solve
from tidewell.operators.windows import lag_matrix, lead_targets, look_back


@dataclass(frozen=True)
class StepModel:
    """One linear model per step ahead. Feature order: lag n..1, price then volume."""

    lags: int
    weights: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]

    @property
    def horizon(self) -> int:
        return len(self.intercepts)


def training_table(bars: DataFrame, series: str, day: str, lags: int, horizon: int) -> tuple[DataFrame, list[str]]:
    """Lags n..1 and targets t+1..t+h per row. The current value is in neither."""
    features = [f"{c}_lag{i}" for i in range(lags, 0, -1) for c in ("close", "volume")]
    lagged = lag_matrix(bars, series, day, ["close", "volume"], lags)
    return lead_targets(lagged, series, day, "close", horizon), features


def fit_direct(bars: DataFrame, series: str, day: str, lags: int, horizon: int, ridge: float = 0.01) -> StepModel:
    """The models of all steps from one job: their features are the same, so one matrix of second moments serves them all."""
    table, features = training_table(bars, series, day, lags, horizon)
    targets = [f"close_lead{j}" for j in range(1, horizon + 1)]
    summary = moments(table, [*features, *targets])
    if summary is None:
        raise ValueError("no row has a full history and all values ahead")
    weights, intercepts = solve(summary, len(features), ridge)
    return StepModel(lags, tuple(tuple(w) for w in weights.tolist()), tuple(intercepts.tolist()))


def predict_direct(bars: DataFrame, series: str, day: str, model: StepModel) -> DataFrame:
    """All ``horizon`` values ahead of every row with a full history, as expressions."""
    features = [f"{c}_lag{i}" for i in range(model.lags, 0, -1) for c in ("close", "volume")]
    lagged = lag_matrix(bars, series, day, ["close", "volume"], model.lags)
    steps = []
    for weights, intercept in zip(model.weights, model.intercepts):
        value = F.lit(intercept)
        for name, w in zip(features, weights):
            value = value + F.col(name) * w
        steps.append(value)
    return lagged.select(
        series, day, *(s.alias(f"forecast{j}") for j, s in enumerate(steps, start=1))
    )


def _roll(history: np.ndarray, volume: np.ndarray, model: StepModel, days: int) -> np.ndarray:
    """Forecast ``days`` values for many series at once, feeding predictions back."""
    weights = np.array(model.weights)
    intercepts = np.array(model.intercepts)
    held = volume[:, -1:]
    blocks, made = [], 0
    while made < days:
        inputs = np.stack([history, volume], axis=2).reshape(len(history), -1)
        block = inputs @ weights.T + intercepts
        block = block[:, : min(model.horizon, days - made)]
        blocks.append(block)
        made += block.shape[1]
        history = np.concatenate([history, block], axis=1)[:, -model.lags :]
        volume = np.concatenate([volume, np.repeat(held, block.shape[1], axis=1)], axis=1)[:, -model.lags :]
    return np.concatenate(blocks, axis=1)


def forecast_recursive(
    bars: DataFrame, series: str, day: str, model: StepModel, reference, days: int
) -> DataFrame:
    """Beyond the model's horizon by using predictions as input; the last volume is held.

    The input is one row per series with two arrays of fixed length, so the recursion
    runs on Arrow batches of series without gathering any group.
    """
    if days <= 0:
        raise ValueError("days must be positive")
    window = look_back(bars, series, day, ["close", "volume"], reference, model.lags)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                close = np.stack(batch["close"].to_numpy()).astype(float)
                volume = np.stack(batch["volume"].to_numpy()).astype(float)
                rolled = _roll(close, volume, model, days)
                yield pd.DataFrame({series: batch[series], "forecast": list(rolled)})

    kind = bars.schema[series].dataType.simpleString()
    rolled = window.mapInPandas(run, f"`{series}` {kind}, forecast array<double>")
    ahead = rolled.select(series, F.posexplode("forecast").alias("step", "predicted_close"))
    return ahead.select(
        series, F.date_add(F.lit(reference), F.col("step") + 1).alias(day), "predicted_close"
    )


def history_and_forecast(
    bars: DataFrame, series: str, day: str, forecast: DataFrame, reference, lookback: int
) -> DataFrame:
    """Past closes of the look-back period beside the forecast, aligned by date."""
    start = F.date_sub(F.lit(reference), lookback)
    past = bars.where((F.col(day) >= start) & (F.col(day) <= F.lit(reference))).select(
        series, day, F.col("close").alias("historical_close")
    )
    return past.join(forecast, [series, day], "full")


def series_trend(bars: DataFrame, series: str, day: str, value: str) -> DataFrame:
    """Least-squares slope per day of each series; null where all days are the same."""
    return bars.groupBy(series).agg(
        F.count("*").alias("n"), F.regr_slope(F.col(value).cast("double"), F.unix_date(day).cast("double")).alias("slope")
    )
