"""Exact quantiles of many columns at once.

One aggregate sketches every column; the sketch brackets each quantile. A second pass over the columns, as arrays, counts what lies below each
bracket and the values within, so a row is never taken apart into a row for each column, and only the values within brackets are ordered.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.ordered import LEAST_BRACKETED, MARGIN, SKETCH, exact_quantiles, running_sums
from tidewell.session import spread, stage

#: So many counted values are ordered by one task for each bracket; more by ranges.
MOST_IN_WINDOW = 2_000_000


@dataclass(frozen=True)
class Quantiles:
    """Of one column: values that are not null, the levels, and how many values lie below each level."""

    n: int
    levels: list[float | None]
    below: list[int]


def _bracketed(rows: DataFrame, columns: Sequence[str], lows: list[list[float]], highs: list[list[float]]) -> DataFrame:
    """(c, i, v, n): how often value v of column c lies in bracket i; null v: how many values lie below it."""

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            out: list[tuple] = []
            for c in range(len(columns)):
                v = frame.column(c).drop_null().to_numpy(zero_copy_only=False)
                if not len(v):
                    continue
                v = np.sort(v)
                for i, (low, high) in enumerate(zip(lows[c], highs[c])):
                    start, end = np.searchsorted(v, low, "left"), np.searchsorted(v, high, "right")
                    values, counts = np.unique(v[start:end], return_counts=True)
                    out.append((np.full(len(values) + 1, c), np.full(len(values) + 1, i), np.append(values, np.nan), np.append(counts, start)))
            if out:
                c, i, v, n = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(v, pa.float64(), mask=np.isnan(v)), pa.array(n, pa.int64())], names=["c", "i", "v", "n"]
                )

    counted = rows.mapInArrow(count, "c int, i int, v double, n bigint")
    return counted.groupBy("c", "i", "v").agg(F.sum("n").alias("n"))


def quantiles_of(df: DataFrame, columns: Sequence[str], fractions: Sequence[float]) -> dict[str, Quantiles] | None:
    """Linearly interpolated quantiles of every column over its values that are not null; None if a column holds NaN.

    Two scans of the columns, whatever their number; of the rows only counted values within brackets are ordered, in ranges if they are many.
    """
    rows = spread(df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))))
    names = rows.columns
    inner = [f for f in fractions if 0 < f < 1]
    marks = [max(0.0, f - MARGIN) for f in inner] + [min(1.0, f + MARGIN) for f in inner]
    sketch = rows.agg(
        *(x for c in names for x in (
            F.count(c).alias(f"{c}_n"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.count_if(F.isnan(c)).alias(f"{c}_nan"),
            *([F.percentile_approx(c, marks, SKETCH).alias(f"{c}_q")] if inner else []),
        ))
    ).first()
    if any(sketch[f"{c}_nan"] for c in names):
        return None
    lows, highs = [], []
    for c in names:
        n, least, most = (sketch[f"{c}_{x}"] for x in ("n", "min", "max"))
        if n < LEAST_BRACKETED or not inner:
            lows.append([least] * len(inner) if n else [])
            highs.append([most] * len(inner) if n else [])
        else:
            q = sketch[f"{c}_q"]
            lows.append(list(q[: len(inner)]))
            highs.append(list(q[len(inner) :]))
    found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
    if inner and any(lows):
        counted = stage(_bracketed(rows, names, lows, highs), "brackets")
        ask = [(c, i, int(floor(f * (sketch[f"{names[c]}_n"] - 1))), int(ceil(f * (sketch[f"{names[c]}_n"] - 1)))) for c in range(len(names)) for i, f in enumerate(inner) if sketch[f"{names[c]}_n"]]
        places = df.sparkSession.createDataFrame(ask, "c int, i int, first bigint, last bigint")
        order = [F.col("v").asc_nulls_first()]
        if counted.count() <= MOST_IN_WINDOW:
            upto = Window.partitionBy("c", "i").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
            placed = counted.withColumn("upto", F.sum("n").over(upto))
        else:
            placed = running_sums(counted, ["c", "i"], order, {"upto": F.col("n")})
        start = F.col("upto") - F.col("n")
        # at most two rows for each column and fraction
        hits = placed.where("v IS NOT NULL").join(F.broadcast(places), ["c", "i"]).where((start <= F.col("last")) & (F.col("upto") > F.col("first")))
        for r in hits.select("c", "i", "v", start.alias("start"), "upto").collect():
            found.setdefault((r["c"], r["i"]), []).append((r["v"], r["start"], r["upto"]))
    out = {}
    for c, (name, key) in enumerate(zip(columns, names)):
        n, least, most = (sketch[f"{key}_{x}"] for x in ("n", "min", "max"))
        levels, below, at = [], [], 0
        for f in fractions:
            if not n:
                levels.append(None)
                below.append(0)
            elif f <= 0 or f >= 1:
                levels.append(least if f <= 0 else most)
                below.append(0 if f <= 0 else -1)
            else:
                position = f * (n - 1)
                rows_at = sorted(found[c, at])
                low = next(r for r in rows_at if r[1] <= floor(position) < r[2])
                high = next(r for r in rows_at if r[1] <= ceil(position) < r[2])
                level = low[0] + (high[0] - low[0]) * (position - floor(position))
                levels.append(level)
                below.append(low[1] if level <= low[0] else high[1] if level >= high[0] else low[2])
            at += 0 < f < 1
        out[name] = Quantiles(n, levels, below)
    return out


def column_quantiles(df: DataFrame, column: str, fractions: Mapping[str, float]) -> DataFrame:
    """One row with the named quantiles of a column, null without values."""
    found = quantiles_of(df, [column], list(fractions.values()))
    if found is None:  # NaN has a place of its own in Spark's order
        return exact_quantiles(df, [], column, fractions)
    row = tuple(None if v is None else float(v) for v in found[column].levels)
    return df.sparkSession.createDataFrame([row], ", ".join(f"`{n}` double" for n in fractions))
