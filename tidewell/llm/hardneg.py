"""Hard negatives by exact integer scores, looked up instead of multiplied (the method of four Russians).

Eight dimensions of an anchor make a table of the sums of all 256 subsets of its components. Eight dimensions of
a candidate, cut in bit planes, are a byte per plane, and a byte is an index to that table. The score is
the sum of the looked-up sums over all groups of eight, added plane by plane from the sign down with a shift between.
Anchors lie in the shared folder in files of bounded size; every task scores its own candidates, block by block, against all of them
and hands on only the few best of each anchor. One pass finds the positives, a second one the negatives between the
limits that the positives set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import write_and_read, written
from tidewell.llm.files import open_store

#: Positives of an anchor, and negatives of an anchor and positive.
POSITIVES, NEGATIVES = 5, 3
#: A negative scores between these percentages of its positive.
LOW, HIGH = 50, 95
#: Components are multiplied by this and floored.
SCALE = 256
GROUP = 8
#: Candidates that a task scores at once; anchors in a file; anchors whose tables are used at once (1 MB of tables for 64 dimensions).
CHUNK_ROWS, FILE_ANCHORS, TABLE_ANCHORS = 16_384, 4_096, 128
#: Candidates whose lookups stay in the processor's cache.
STRIP_ROWS = 1_024

PARTNERS = "array<struct<id:bigint,score:bigint>>"


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each group of eight dimensions the sums of all subsets of components; bit i of an index stands for dimension i."""
    n, dims = anchors.shape
    groups = -(-dims // GROUP)
    padded = np.zeros((n, groups * GROUP), anchors.dtype)
    padded[:, :dims] = anchors
    parts = padded.reshape(n, groups, GROUP).transpose(1, 2, 0)
    tables = np.zeros((groups, 1 << GROUP, n), anchors.dtype)
    for bit in range(GROUP):
        half = 1 << bit
        tables[:, half : 2 * half] = tables[:, :half] + parts[:, bit : bit + 1]
    return tables


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes of the two's complement of the components, the sign plane first; bit i of a byte stands for dimension i."""
    n, dims = values.shape
    widest = int(np.maximum(values, ~values).max(initial=0)).bit_length()  # ~v is -v - 1: the bits of a negative number beside its sign
    padded = np.zeros((n, -(-dims // GROUP) * GROUP), np.int64)
    padded[:, :dims] = values
    planes = [np.packbits(((padded >> k) & 1).astype(np.uint8), axis=1, bitorder="little") for k in range(widest, -1, -1)]
    return np.ascontiguousarray(np.stack(planes).transpose(0, 2, 1))


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(anchors, rows): inner products, by lookups, additions and shifts."""
    groups, _, anchors = tables.shape
    rows = planes.shape[2]
    out = np.empty((anchors, rows), tables.dtype)
    looked = np.empty((STRIP_ROWS, anchors), tables.dtype)
    for at in range(0, rows, STRIP_ROWS):
        strip = planes[:, :, at : at + STRIP_ROWS]
        size = strip.shape[2]
        total = np.zeros((size, anchors), tables.dtype)
        for k, plane in enumerate(strip):
            if k:
                total <<= 1
            for g in range(groups):
                np.take(tables[g], plane[g], axis=0, out=looked[:size], mode="clip")
                total += looked[:size]
            if k == 0:
                np.negative(total, out=total)  # the sign plane weighs negative
        out[:, at : at + size] = total.T
    return out


def reach(values: np.ndarray) -> int:
    """Bits of the largest magnitude."""
    return max(int(values.max(initial=0)), -int(values.min(initial=0))).bit_length()


def dtype_for(anchors: np.ndarray, candidate_bits: int) -> type:
    """The narrowest integers in which no sum can overflow."""
    bits = reach(anchors) + candidate_bits + 1 + max(1, anchors.shape[1]).bit_length()
    if bits > 62:
        raise ValueError(f"vector components too large: scores may need {bits} bits, a long has 63")
    return np.int32 if bits <= 30 else np.int64


def best(found: np.ndarray, ids: np.ndarray, nameless: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the first ``most`` entries of every row: highest first, ties by smallest id, null ids last.

    Entries at the type's minimum are left out.
    """
    lowest = np.iinfo(found.dtype).min
    if not found.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if found.shape[1] > most:
        level = np.partition(found, found.shape[1] - most, axis=1)[:, found.shape[1] - most]
        keep = (found >= level[:, None]) & (found > lowest)
    else:
        keep = found > lowest
    row, column = np.nonzero(keep)
    order = np.lexsort((ids[column], nameless[column], -found[row, column].astype(np.int64), row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < most], column[place < most]


class Rows:
    """Columns of an Arrow table: ids (null ones marked), labels and a matrix of components, short vectors filled with zeros."""

    def __init__(self, table: pa.Table):
        ids = table.column("id").combine_chunks()
        self.nameless = pc.is_null(ids).to_numpy(zero_copy_only=False)
        self.ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        self.labels = table.column("label").to_numpy()
        lists = table.column("q").combine_chunks()
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        dims = int(lengths.max(initial=0))
        flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        self.values = np.zeros((len(lengths), dims), np.int64)
        self.values[np.arange(dims)[None, :] < lengths[:, None]] = flat


class Candidates(Rows):
    """Rows by label, cut in bit planes."""

    def __init__(self, table: pa.Table):
        super().__init__(table.take(pc.sort_indices(table, [("label", "ascending")])))
        self.bits, self.dims = reach(self.values), self.values.shape[1]
        self.planes = bit_planes(self.values)
        del self.values

    def scores(self, anchors: np.ndarray, which: slice) -> np.ndarray:
        """Scores of anchors with a range of the rows. Dimensions that only one side has add nothing."""
        fitted = np.zeros((len(anchors), self.dims), np.int64)
        common = min(self.dims, anchors.shape[1])
        fitted[:, :common] = anchors[:, :common]
        return scores(subset_sums(fitted.astype(dtype_for(fitted, self.bits))), self.planes[:, :, which])


def anchor_blocks(folder: str) -> Iterator[pa.Table]:
    """The anchors of a folder in blocks of at most TABLE_ANCHORS, file by file."""
    store, path = open_store(folder)
    names = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))
    for name in names:
        table = pq.read_table(name, filesystem=store)
        for at in range(0, len(table), TABLE_ANCHORS):
            yield table.slice(at, TABLE_ANCHORS)


def _chunks(frames: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, rows = [], 0
    for frame in frames:
        if frame.num_rows:
            held.append(frame)
            rows += frame.num_rows
        if rows >= most:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def near_same(folder: str, most: int, chunk_rows: int):
    """Of each chunk of candidates, the best of an anchor's own label."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(frames, chunk_rows):
            rows = Candidates(table)
            for part in anchor_blocks(folder):
                block = Rows(part)
                aids = part.column("aid").to_numpy()
                for label in np.unique(block.labels):
                    mine = slice(*np.searchsorted(rows.labels, [label, label + 1]))
                    if mine.start == mine.stop:
                        continue
                    own = np.flatnonzero(block.labels == label)
                    ids, nameless = rows.ids[mine], rows.nameless[mine]
                    found = rows.scores(block.values[own], mine)
                    found[(ids[None, :] == block.ids[own][:, None]) & ~nameless[None, :]] = np.iinfo(found.dtype).min
                    a, c = best(found, ids, nameless, most)
                    if len(a):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(aids[own][a]), pa.array(ids[c], mask=nameless[c]), pa.array(found[a, c].astype(np.int64))],
                            names=["aid", "id", "score"],
                        )

    return work


def near_other(folder: str, most: int, low: int, high: int, chunk_rows: int):
    """Of each chunk of candidates, the best of other labels between the limits of every positive of an anchor."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(frames, chunk_rows):
            rows = Candidates(table)
            for part in anchor_blocks(folder):
                block = Rows(part)
                aids = part.column("aid").to_numpy()
                lists = part.column("positives").combine_chunks()
                count = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                flat = pc.struct_field(pc.list_flatten(lists), "score").to_numpy(zero_copy_only=False)
                starts = np.cumsum(count) - count
                found = rows.scores(block.values, slice(None)).astype(np.int64)
                lowest = np.iinfo(np.int64).min
                found[block.labels[:, None] == rows.labels[None, :]] = lowest
                for p in range(int(count.max(initial=0))):
                    own = np.flatnonzero(count > p)
                    positive = flat[starts[own] + p]
                    floor, top = -(-positive * low // 100), positive * high // 100
                    some = own[floor <= top]
                    floor, top = floor[floor <= top], top[floor <= top]
                    part_scores = found[some]
                    part_scores[(part_scores > top[:, None]) | (part_scores < floor[:, None])] = lowest
                    a, c = best(part_scores, rows.ids, rows.nameless, most)
                    if len(a):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(aids[some][a]), pa.array(np.full(len(a), p, np.int32)), pa.array(rows.ids[c], mask=rows.nameless[c]), pa.array(part_scores[a, c])],
                            names=["aid", "p", "id", "score"],
                        )

    return work


def usable(vectors: DataFrame, vec_id: str, vector: str, label: str, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """(id, label, q): rows with a label and finite components only; every seventh id gets the next label, components are scaled and floored."""
    x = F.col(vector)
    fine = F.col(label).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    changed = F.pmod(F.col(vec_id), F.lit(relabel_every)) == 0
    own = F.col(label).cast("bigint")
    return vectors.where(fine).select(
        F.col(vec_id).cast("bigint").alias("id"),
        F.when(changed, (own + 1) % labels).otherwise(own).alias("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("q"),
    )


def hard_negatives(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 50,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per anchor, positive and negative: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Anchors are the rows whose id is divisible by ``every``. Scores are exact integers; the first rows are those with the highest
    score, ties by smallest id. Rows with a null label, a null vector or a component that is null, NaN or infinite take no part. A row with a
    null id is a candidate, last among ties. Rows with the anchor's own id are not its partners; repeated rows count as often as they occur,
    also as anchors. Of vectors of different lengths the shorter is filled with zeros; an empty one scores 0. Anchors without a positive,
    and positives without a negative, give no row; an empty table gives an empty table; other columns are not read. Components so large
    that a score might not fit a long are refused with a ValueError.
    """
    rows = write_and_read(usable(vectors, vec_id, vector, label), "vectors")
    anchors = rows.where(F.pmod("id", F.lit(every)) == 0).withColumn("aid", F.monotonically_increasing_id())
    anchors = write_and_read(anchors, "anchors")
    files = max(1, -(-anchors.count() // FILE_ANCHORS))

    folder = written(anchors.repartition(files), "anchorfiles", maxRecordsPerFile=FILE_ANCHORS)
    close = rows.mapInArrow(near_same(folder, positives, chunk_rows), "aid bigint, id bigint, score bigint")
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    close = close.withColumn("place", F.row_number().over(Window.partitionBy("aid").orderBy(*order))).where(F.col("place") <= positives)
    # at most ``positives`` rows of each anchor
    entry = F.struct("place", F.struct("id", "score").alias("partner"))
    lists = close.groupBy("aid").agg(F.sort_array(F.collect_list(entry)).alias("l")).select("aid", F.col("l.partner").cast(PARTNERS).alias("positives"))
    aimed = write_and_read(anchors.join(lists, "aid"), "positives")

    folder = written(aimed.repartition(files), "aimedfiles", maxRecordsPerFile=FILE_ANCHORS)
    far = rows.mapInArrow(near_other(folder, negatives, low, high, chunk_rows), "aid bigint, p int, id bigint, score bigint")
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("aid", "p").orderBy(*order))).where(F.col("rank") <= negatives)
    named = aimed.select("aid", F.col("id").alias("anchor_id"), F.posexplode("positives").alias("p", "positive"))
    return far.join(named, ["aid", "p"]).select(
        "anchor_id", F.col("positive.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
