"""What every filter removes, in every order of the filters, from one pass over the documents.

A document fails a set of filters, its mask. In an order, it goes at the smallest position among the filters it fails:
a min-plus product of the mask matrix (0 where a filter fails, infinite elsewhere) with the matrix of the inverse permutations
(the position of each filter in each order). Documents with equal masks go together, so the product has at most 32 rows a part, weighted
by how many documents they stand for, and the counts of all orders and steps are scatter sums of those weights.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import strings, write_and_read
from tidewell.operators.attach import attach

FILTERS = "ABCDE"
#: Limits of A (words), B and C (percent).
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 3
SYMBOLS = b"#$%&*|"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPY = 1 << FILTERS.index("E")

ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Row f, column o: position of filter f in order o.
POSITIONS = np.array([[o.index(f) for o in ORDERS] for f in FILTERS], np.int64)
#: Step of a document that fails nothing.
NEVER = len(FILTERS)

MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_mask(text: str) -> int:
    """The filters A to D that a text fails, a bit each."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    upper = len(raw) - len(raw.translate(None, UPPER))
    failed = (
        n < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT * n, 100 * upper > MAX_UPPER * len(text), len(raw.translate(None, SYMBOLS)) < len(raw),
    )
    return sum(1 << i for i, f in enumerate(failed) if f)


def removal_steps(masks: np.ndarray) -> np.ndarray:
    """(masks, orders): the first position, from 0, of a filter that the mask fails; NEVER if none."""
    fails = (masks[:, None] >> np.arange(len(FILTERS))) & 1
    cost = np.where(fails == 1, 0, NEVER)
    return np.minimum((cost[:, :, None] + POSITIONS[None, :, :]).min(axis=1), NEVER)


def audit_counts(masks: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Counts (orders, steps) of one part from its masks and their weights (masks, 3): documents, good ones, toxic ones."""
    steps, size = removal_steps(masks), len(FILTERS)
    lost = np.zeros((3, len(ORDERS), size + 1), np.int64)
    order = np.broadcast_to(np.arange(len(ORDERS)), steps.shape)
    for k in range(3):
        np.add.at(lost[k], (order, steps), np.broadcast_to(weights[:, k : k + 1], steps.shape))
    removed = lost[0, :, :size]
    fails = (masks[:, None] >> np.arange(size)) & 1
    failing = (fails * weights[:, :1]).sum(axis=0)
    alone = np.array([weights[masks == 1 << f, 0].sum() for f in range(size)], np.int64)
    filter_at = np.argsort(POSITIONS, axis=0).T  # (orders, steps): the filter of each step
    shapley = np.zeros(size, np.int64)
    np.add.at(shapley, filter_at, removed)
    return {
        "kept": weights[:, 0].sum() - np.cumsum(removed, axis=1), "removed": removed, "redundant": failing[filter_at] - removed,
        "unique_fails": alone[filter_at], "good_lost": lost[1, :, :size], "toxic_lost": lost[2, :, :size], "shapley": shapley[filter_at],
    }


def masked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, mask, d1, d2): failures of A to D, and a digest of the text."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = strings(frame.column(2))
            digests = b"".join(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:16] for t in texts)
            halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), frame.column(1), pa.array([text_mask(t) for t in texts], pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                names=["doc_id", "part", "mask", "d1", "d2"],
            )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))
    return rows.mapInArrow(work, "doc_id bigint, part string, mask int, d1 bigint, d2 bigint")


def interaction_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step, with the counts of ``MEASURES``; see the module.

    A part is a value of ``part``, null as the empty string. A null text counts as empty, so it fails A, as does an empty one, and is a copy of
    other empty texts. Filter E fails where another row of the whole table has the same text and a smaller id; rows without an id never fail it and make no other fail it;
    repeated rows do not fail through each other, and count as often as they occur. A label counts if any row of ``labels`` with the
    id states it; rows of it without an id count for nothing. An empty table gives an empty table; other columns are not read.
    """
    rows = write_and_read(masked(docs, doc_id, text, part), "masks")
    copies = rows.where("doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    placed = attach(rows, copies.select("d1", "d2", "first"), ["d1", "d2"])
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    failed = placed.select("doc_id", "part", F.when(copy, F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask")).alias("mask"))

    said = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    said = said.groupBy("doc_id").agg(*(F.max(F.coalesce(F.col(c), F.lit(False)).cast("bigint")).alias(c) for c in ("good", "toxic")))
    judged = attach(failed, said, ["doc_id"])
    weighed = judged.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    # at most 32 masks a part
    parts = weighed.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(np.repeat(ORDERS, NEVER))
        steps = pa.array(np.tile(np.arange(1, NEVER + 1, dtype=np.int32), len(ORDERS)))
        for frame in frames:
            for name, cells in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                table = np.array([[c["mask"], c["n"], c["good"], c["toxic"]] for c in cells], np.int64)
                found = audit_counts(table[:, 0], table[:, 1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(names)), names, steps, *(pa.array(found[m].ravel()) for m in MEASURES)],
                    names=["part", "filter_order", "step", *MEASURES],
                )

    return parts.mapInArrow(count, "part string, filter_order string, step int, " + ", ".join(f"{m} bigint" for m in MEASURES))
