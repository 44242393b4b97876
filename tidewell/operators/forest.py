"""A random forest for regression whose work per row does not grow with trees, levels and passes.

Columns are binned as trees of bounded bins do anyway; rows whose bins are all equal form a cell, which no tree can split. Each row draws its
bootstrap weight for every tree once and is summed into its cell; the trees then grow over the cells, one pass for each level of all trees. There are at most as
many cells as rows, and at most ``BINS`` to the power of the number of columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.moments import _add, merged
from tidewell.session import stage

#: Bins of a column, quantiles that are looked at for them, and cells that a task sums at a time.
BINS, QUANTILES, CELLS = 32, 1024, 1 << 16


@dataclass(frozen=True)
class Forest:
    """Per tree its nodes, the children of i at 2i + 1 and 2i + 2: column (-1 for a leaf), threshold (at most goes left) and mean."""

    columns: tuple[str, ...]
    feature: tuple[tuple[int, ...], ...]
    threshold: tuple[tuple[float, ...], ...]
    value: tuple[tuple[float, ...], ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the prediction, the mean over the trees. A null or NaN among the columns is refused."""
        forest = [tuple(map(np.array, tree)) for tree in zip(self.feature, self.threshold, self.value)]

        @F.arrow_udf("double")
        def predicted(*x: pa.Array) -> pa.Array:
            z = np.stack([a.to_numpy(zero_copy_only=False).astype(np.float64) for a in x])
            if np.isnan(z).any():
                raise ValueError("rows with a missing feature")
            rows, total = np.arange(z.shape[1]), np.zeros(z.shape[1])
            for feature, threshold, value in forest:
                node = np.zeros(len(rows), np.int64)
                for _ in range(len(feature).bit_length() - 1):
                    f = feature[node]
                    node = np.where(f < 0, node, 2 * node + 1 + (z[f, rows] > threshold[node]))
                total += value[node]
            return pa.array(total / len(forest))

        return df.withColumn("prediction", predicted(*(F.col(c).cast("double") for c in self.columns)))


def thresholds(train: DataFrame, columns: Sequence[str], label: str) -> list[np.ndarray]:
    """Per column at most 31: the middles between its values if these are few, else quantiles, both from all rows."""
    at = F.array(*(F.lit(i / QUANTILES) for i in range(QUANTILES + 1)))
    gone = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in [*columns, label]]
    found = train.agg(
        F.count("*"), F.count_if(sum((g.cast("int") for g in gone), F.lit(0)) > 0), *(F.percentile_approx(F.col(c).cast("double"), at, 10 * QUANTILES) for c in columns)
    ).first()
    if found[1]:
        raise ValueError("rows with a missing feature or label")
    if not found[0]:
        raise ValueError("no rows to fit")
    cuts = []
    for quantiles in map(np.array, found[2:]):
        values = np.unique(quantiles)
        middles = values[:-1] + (values[1:] - values[:-1]) / 2
        cuts.append(middles if len(values) <= BINS else np.setdiff1d(quantiles[:: QUANTILES // BINS][1:-1], values[-1:]))
    return cuts


def cells(train: DataFrame, columns: Sequence[str], label: str, cuts: list[np.ndarray], trees: int, seed: int) -> DataFrame:
    """Cells (one byte of bin for each column) with, tree after tree, the sums of weights, weighted labels and weighted squares of labels.

    A cell may come in several rows.
    """
    size = len(columns)

    def binary(b: np.ndarray) -> pa.Array:
        ends = np.arange(0, b.size + 1, size, dtype=np.int32)
        return pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(b, np.uint8))])

    def binned(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            x = (frame.column(i).to_numpy(zero_copy_only=False) for i in range(size))
            b = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x)], axis=1)
            yield pa.RecordBatch.from_arrays([binary(b), frame.column(size)], names=["cell", "y"])

    def summed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng([seed % 2**64, TaskContext.get().partitionId()])
        place: dict[bytes, int] = {}
        sums = np.zeros((CELLS, 3 * trees))

        def out() -> Iterator[pa.RecordBatch]:
            names = list(place)
            for i in range(0, len(names), 8192):
                part = sums[i : min(i + 8192, len(names))]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, 3 * trees), pa.int32()), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 8192], pa.binary()), lists], names=["cell", "sums"])

        for frame in frames:
            if not frame.num_rows:
                continue
            coded = frame.column(0).dictionary_encode()
            if len(place) + len(coded.dictionary) > CELLS:
                yield from out()
                place.clear()
                sums = np.zeros((max(CELLS, len(coded.dictionary)), 3 * trees))
            at = np.array([place.setdefault(c, len(place)) for c in coded.dictionary.to_pylist()])
            code, y = coded.indices.to_numpy(), frame.column(1).to_numpy()
            order = np.argsort(code, kind="stable")
            w, y = random.poisson(1.0, (len(y), trees)).astype(np.float64), y[order, None]
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            # tree after tree: weight, weighted label, weighted square
            sums[at] += np.add.reduceat(np.stack([w, w * y, w * y * y], axis=2).reshape(len(y), -1), starts, axis=0)
        yield from out()

    plain = train.select(*(F.col(c).cast("double") for c in columns), F.col(label).cast("double").alias("y"))
    # rows of a cell meet in one task, unless it is so frequent that it is split
    return plain.mapInArrow(binned, "cell binary, y double").hint("rebalance", F.col("cell")).mapInArrow(summed, "cell binary, sums array<double>")


def grow(rows: DataFrame, cuts: list[np.ndarray], trees: int, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, threshold, mean) of every node: at each level the split of most gain in variance, among a third of the columns for each node."""
    size, bins, nodes = len(cuts), max(len(c) for c in cuts) + 1, 2 ** (depth + 1) - 1
    feature, split = np.full((trees, nodes), -1), np.zeros((trees, nodes), np.int64)
    threshold, value = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    few = math.ceil(size / 3) if trees > 1 else size
    random = np.random.default_rng(seed % 2**64)
    for level in range(depth):
        first, wide = 2**level - 1, 2**level
        open_ = feature[:, (first - 1) // 2 : first].repeat(2, axis=1) >= 0 if level else np.ones((trees, 1), bool)
        if not open_.any():
            break
        chosen = np.sort(random.permuted(np.tile(np.arange(size), (trees, wide, 1)), axis=2)[:, :, :few], axis=2)

        def task(frames: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
            total = np.zeros((trees, 3, wide * few * bins))
            for frame in frames:
                n = frame.num_rows
                if not n:
                    continue
                x = np.frombuffer(b"".join(frame.column(0).to_pylist()), np.uint8).reshape(n, size)
                sums = frame.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, trees, 3)
                each = np.arange(n)
                for t in range(trees):
                    node, alive = np.zeros(n, np.int64), np.ones(n, bool)
                    for _ in range(level):
                        f = feature[t][node]
                        alive &= f >= 0
                        node = np.where(alive, 2 * node + 1 + (x[each, f] > split[t][node]), 0)
                    node = node[alive] - first
                    for j in range(few):
                        flat = (node * few + j) * bins + x[each[alive], chosen[t, node, j]]
                        for k in range(3):
                            total[t, k] += np.bincount(flat, sums[alive, t, k], wide * few * bins)
            return [total]

        found = merged(rows, task, _add)[0].reshape(trees, 3, wide, few, bins)
        for t, i in zip(*np.nonzero(open_)):
            left = found[t, :, i].cumsum(axis=2)
            whole = left[:, 0, -1]
            if whole[0] <= 0:
                continue
            right = whole[:, None, None] - left
            # weight times variance, of the node and of both parts
            rest = lambda s: s[2] - s[1] * s[1] / np.maximum(s[0], 1.0)
            gain = np.where((left[0] >= 1) & (right[0] >= 1), rest(whole) - rest(left) - rest(right), 0.0)
            j, b = np.unravel_index(gain.argmax(), gain.shape)
            here = first + i
            if not level:
                value[t, here] = whole[1] / whole[0]
            # what is within the rounding of the squares is no gain
            if gain[j, b] > 1e-12 * abs(whole[2]):
                f = chosen[t, i, j]
                feature[t, here], split[t, here], threshold[t, here] = f, b, cuts[f][b]
                value[t, 2 * here + 1] = left[1, j, b] / left[0, j, b]
                value[t, 2 * here + 2] = right[1, j, b] / right[0, j, b]
    return feature, threshold, value


def fit(train: DataFrame, columns: Sequence[str], label: str, trees: int, depth: int, seed: int) -> Forest:
    cuts = thresholds(train, columns, label)
    rows = stage(cells(train, columns, label, cuts, trees, seed), "cells")
    return Forest(tuple(columns), *(tuple(map(tuple, a.tolist())) for a in grow(rows, cuts, trees, depth, seed)))
