"""Sums that merge: second moments of many columns, and the Newton sums of many weighted logistic models, each in one job.

Tasks sum what they read in small matrices; the matrices are merged in ``SLOTS`` groups, and at most that many
reach the driver. Their size is the square of the number of columns and does not depend on the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 16


def merged(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], list[np.ndarray] | None], merge: Callable) -> list[np.ndarray] | None:
    """Sums of all tasks, in one job: ``task`` turns the batches of a task into arrays, ``merge`` adds two lists of them. None without rows."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = task(frames)
        if found is not None:
            shapes = [list(a.shape) for a in found]
            flat = np.concatenate([a.ravel() for a in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32()), pa.array([shapes], pa.list_(pa.list_(pa.int64()))), pa.array([flat.tobytes()], pa.binary())],
                names=["slot", "shapes", "sums"],
            )

    def arrays(shapes: list, sums: bytes) -> list[np.ndarray]:
        sizes = np.cumsum([int(np.prod(s)) for s in shapes])
        return [part.reshape(s) for part, s in zip(np.split(np.frombuffer(sums, np.float64), sizes[:-1]), shapes)]

    def combine(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("sums").to_pylist(), table.column("shapes").to_pylist()))
        total = reduce(merge, (arrays(shapes, sums) for sums, shapes in rows))
        flat = np.concatenate([a.ravel() for a in total])
        return pa.table({"slot": table.column("slot")[:1], "shapes": table.column("shapes")[:1], "sums": pa.array([flat.tobytes()], pa.binary())})

    ddl = "slot int, shapes array<array<bigint>>, sums binary"
    rows = df.mapInArrow(run, ddl).groupBy("slot").applyInArrow(combine, ddl).collect()
    parts = [arrays(r["shapes"], r["sums"]) for r in sorted(rows, key=lambda r: r["slot"])]
    return reduce(merge, parts) if parts else None


@dataclass(frozen=True)
class Moments:
    """Rows, means and the matrix of summed products of deviations from them."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        """Of the rows themselves, not an estimate from a sample."""
        return self.scatter / self.n

    @property
    def deviation(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.covariance), 0.0))


def _merge_moments(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    (nx, mx, sx), (ny, my, sy) = x, y
    n = nx + ny
    gap = my - mx
    return [n, mx + gap * (ny / n), sx + sy + np.outer(gap, gap) * (nx * ny / n)]


def _matrix(frame: pa.RecordBatch, columns: int) -> np.ndarray:
    """Rows of an Arrow batch without those that hold a null or NaN."""
    z = np.column_stack([frame.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(columns)])
    return z[~np.isnan(z).any(axis=1)]


def moments(df: DataFrame, columns: Sequence[str], count: str | None = None) -> Moments | None:
    """Second moments of the columns over the rows without a null or NaN in any of them; None without such rows.

    ``count`` names a column that tells how many rows a row stands for.
    """
    size = len(columns)

    def task(frames: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
        total = None
        for frame in frames:
            z = _matrix(frame, size + bool(count))
            if len(z):
                if count:
                    z, n = z[:, :-1], z[:, -1]
                    mean = n @ z / n.sum()
                    away = z - mean
                    own = [np.array(n.sum()), mean, (away * n[:, None]).T @ away]
                else:
                    mean = z.mean(axis=0)
                    away = z - mean
                    own = [np.array(float(len(z))), mean, away.T @ away]
                total = own if total is None else _merge_moments(total, own)
        return total

    found = merged(df.select(*(F.col(c).cast("double") for c in [*columns, *([count] if count else [])])), task, _merge_moments)
    return None if found is None else Moments(float(found[0]), found[1], found[2])


def ridge(summary: Moments, n_features: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights, intercepts) of one linear model for each target, from the moments of features and, after them, targets.

    Features and targets are scaled to unit deviation and the penalty is divided by the target's deviation, as the single fits of MLlib do.
    A feature or target without deviation gets weight 0.
    """
    spread = summary.deviation
    sx, sy = spread[:n_features], spread[n_features:]
    live = sx > 0
    scale = np.where(live, sx, 1.0)
    alike = summary.covariance[:n_features, :n_features] / np.outer(scale, scale)
    weights = np.zeros((len(sy), n_features))
    for j, s in enumerate(sy):
        if s > 0 and live.any():
            left = alike[np.ix_(live, live)] + np.eye(int(live.sum())) * (penalty / s)
            right = summary.covariance[:n_features, n_features + j][live] / (scale[live] * s)
            weights[j, live] = np.linalg.lstsq(left, right, rcond=None)[0] * s / scale[live]
    return weights, summary.mean[n_features:] - weights @ summary.mean[:n_features]


def _add(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    return [a + b for a, b in zip(x, y)]


def newton_sums(df: DataFrame, n_features: int, members: int, beta: np.ndarray, mean: np.ndarray, scale: np.ndarray):
    """(loss, gradient, Hessian) of every member at ``beta`` (members, features + 1), from one pass over (x array, y, w array) rows.

    Features are shifted and scaled; the first coefficient is the level.
    """

    def task(frames: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
        size = n_features + 1
        loss, gradient, hessian = np.zeros(members), np.zeros((members, size)), np.zeros((members, size, size))
        seen = False
        for frame in frames:
            n = frame.num_rows
            if not n:
                continue
            seen = True
            x = np.ones((n, size))
            x[:, 1:] = (frame.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, n_features) - mean) / scale
            y = frame.column(1).to_numpy(zero_copy_only=False)
            w = frame.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, members)
            margin = x @ beta.T
            loss += (w * (np.logaddexp(0.0, margin) - y[:, None] * margin)).sum(axis=0)
            p = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
            gradient += (w * (y[:, None] - p)).T @ x
            curve = w * p * (1 - p)
            for m in range(members):
                hessian[m] += (x * curve[:, m : m + 1]).T @ x
        return [loss, gradient, hessian] if seen else None

    return merged(df, task, _add)
