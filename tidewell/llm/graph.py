"""Connected components of a link table, by joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import FEW, write_and_read

#: Edges that a task contracts at once.
CHUNK_EDGES = 1_000_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smallest node of the component, other node) with the same components as the edges (u, v)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (label[a], label[b]):
            np.minimum.at(new, ends, least)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    hung = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[hung]], nodes[hung]


def _contract(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contract the edges of a task, a bounded number at a time."""
    held, rows = [], 0

    def out() -> pa.RecordBatch:
        u, v = (np.concatenate([f.column(i).to_numpy() for f in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in contracted(u, v)], names=["u", "v"])

    for frame in frames:
        if frame.num_rows:
            held.append(frame)
            rows += frame.num_rows
        if rows >= CHUNK_EDGES:
            yield out()
            held, rows = [], 0
    if held:
        yield out()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and on none that hangs itself."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("n"), F.lit(0).alias("hangs")), F.struct(F.col("v").alias("n"), F.lit(1).alias("hangs")))))
    nodes = ends.groupBy("n").agg(F.sum("hangs").alias("above"), F.min("hangs").alias("least"))
    return not nodes.where((F.col("above") > 1) | ((F.col("above") > 0) & (F.col("least") == 0))).limit(1).count()


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): every node that has a link, with the smallest node of its component.

    Tasks contract the edges that they hold, a bounded number at a time, to stars around the smallest node. While that does not make them stars of the whole
    graph, both ends of each edge hang on the smallest node that either of them is linked with, which keeps components as they are and brings their parts together; then
    tasks contract again. A component of any size is spread over many tasks, and what is joined back is
    written first, so Spark knows its size: a small one is broadcast, and beside a large one the rows of a node with very many links are split.
    Nulls and loops are no links; an empty table gives an empty table.
    """
    ddl = "u bigint, v bigint"
    cores = links.sparkSession.sparkContext.defaultParallelism
    # least and greatest pass over nulls
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = links.select(F.least(a, b).cast("bigint").alias("u"), F.greatest(a, b).cast("bigint").alias("v")).where("u < v")
    while True:
        # few tasks, if the shuffle before it has many small partitions: the more edges a task sees, the more it contracts
        edges = write_and_read(edges.distinct().coalesce(FEW * cores).mapInArrow(_contract, ddl).distinct(), "edges", few=FEW)
        if _all_stars(edges):
            break
        both = F.inline(F.array(F.struct(F.col("u").alias("n"), F.col("u").alias("m")), F.struct(F.col("v").alias("n"), F.col("u").alias("m"))))
        least = write_and_read(edges.select(both).groupBy("n").agg(F.min("m").alias("m")), "least", few=FEW)
        of_u = edges.join(least.withColumnRenamed("m", "mu"), F.col("u") == F.col("n")).drop("n")
        of_v = of_u.join(least.withColumnRenamed("m", "mv"), F.col("v") == F.col("n")).drop("n")
        root = F.least("mu", "mv", "u")
        edges = of_v.select(F.inline(F.array(F.struct(root.alias("u"), F.col("u").alias("v")), F.struct(root.alias("u"), F.col("v").alias("v"))))).where("u < v")
    stars = edges.select(F.col("v").alias("node"), F.col("u").alias("comp"))
    return stars.union(edges.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct())
