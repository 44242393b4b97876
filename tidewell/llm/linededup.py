"""Removal of lines that other documents hold too, by probing a hash index instead of joining lines.

Lines are reduced to a 128-bit key hash, and the hashes of the lines, with their place, are written once. All distinct hashes get into a
minimal perfect hash, cut in shards by the leading bits of the hash: a shard is a stack of bit sets whose ranks give
each hash a slot of its own, and arrays over the slots: fingerprints (the other half of the hash), how many documents hold the line, and the smallest of them.
The hashed lines travel to the shards, the shards say which lines go, and those places travel back to where the texts lie: each
row of the input is known by its file and its number in it. So texts are read twice and never moved, however many shards there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import ASCII_LOWER, SPACE, fresh_folder, strings, write_and_read
from tidewell.llm.files import open_store

MIN_KEY = 10
#: Hashes in one shard, about 1.5 MB of arrays.
SHARD_KEYS = 1 << 16
#: Shards in one folder of the index, whose lines are probed by tasks of their own; a task holds one shard at a time.
BLOCK_SHARDS = 16
#: Tasks that share the lines of a block, so that a line that a third of all documents hold does not meet in one.
PROBE_PARTS = 4
#: Folders of the places of dropped lines, by input file.
MASK_FOLDERS = 64
#: Rows of an input file whose places are written by one task.
MASK_ROWS = 1 << 20
#: Counts above are not told apart.
MOST_COUNT = (1 << 32) - 1
NO_DOC = (1 << 63) - 1
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def line_key(line: str) -> str:
    return line.strip(SPACE).translate(ASCII_LOWER)


def line_hashes(text: str, min_key: int = MIN_KEY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line of the text: two 64-bit hashes of its key, and whether the key is long enough."""
    keys = [line_key(line) for line in text.split("\n")]
    long_enough = np.fromiter((len(k) >= min_key for k in keys), bool, len(keys))
    both = b"".join(
        xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass")) if ok else b"\0" * 16 for k, ok in zip(keys, long_enough)
    )
    halves = np.frombuffer(both, "<u8").reshape(-1, 2)
    return halves[:, 0], halves[:, 1], long_enough


def _slots(key: np.ndarray, level: int, size: int) -> np.ndarray:
    """Pseudo-random slot of every key at one level (a 64-bit finaliser over key and level)."""
    with np.errstate(over="ignore"):
        x = key + np.uint64((level + 1) * _MIX[0] & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
        return (x ^ (x >> np.uint64(31))) % np.uint64(size)


def build_mph(keys: np.ndarray) -> list[np.ndarray]:
    """Bit sets of a minimal perfect hash: at each level the keys that are alone in their slot stay, the others go on."""
    levels = []
    while len(keys):
        size = 2 * len(keys) + 64
        slot = _slots(keys, len(levels), size)
        alone = np.bincount(slot.astype(np.int64), minlength=size) == 1
        levels.append(alone)
        keys = keys[~alone[slot.astype(np.int64)]]
    return levels


def probe_mph(levels: list[np.ndarray], ranks: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of every key; keys that were not built in get some slot or -1."""
    out = np.full(len(keys), -1, np.int64)
    left = np.arange(len(keys))
    for level, (bits, rank) in enumerate(zip(levels, ranks)):
        if not len(left):
            break
        slot = _slots(keys[left], level, len(bits)).astype(np.int64)
        hit = bits[slot]
        out[left[hit]] = rank[slot[hit]]
        left = left[~hit]
    return out


def level_ranks(levels: list[np.ndarray]) -> list[np.ndarray]:
    ranks, base = [], 0
    for bits in levels:
        ranks.append(base + np.cumsum(bits, dtype=np.int64) - 1)
        base += int(bits.sum())
    return ranks


def hashed_lines(docs: DataFrame, doc_id: str, text: str, min_key: int) -> DataFrame:
    """(file, row, line, first, h1, h2, doc): every line with a long enough key; ``first`` marks the first line of the row with the key."""

    def lines(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            ids = pc.fill_null(frame.column(0), NO_DOC).to_numpy(zero_copy_only=False)
            files, rows = (frame.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            parts = []
            for at, t in enumerate(strings(frame.column(1))):
                h1, h2, ok = line_hashes(t, min_key)
                place = np.flatnonzero(ok)
                if len(place):
                    first = np.zeros(len(place), bool)
                    first[np.unique(np.stack([h1[place], h2[place]], 1), axis=0, return_index=True)[1]] = True
                    parts.append((np.full(len(place), at), place, first, h1[place], h2[place]))
            if parts:
                at, place, first, h1, h2 = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(files[at]), pa.array(rows[at]), pa.array(place.astype(np.int32)), pa.array(first), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids[at])],
                    names=["file", "row", "line", "first", "h1", "h2", "doc"],
                )

    rows = docs.select(F.col(doc_id).cast("bigint"), F.col(text), "_tw_file", "_tw_row")
    return rows.mapInArrow(lines, "file bigint, row bigint, line int, first boolean, h1 bigint, h2 bigint, doc bigint")


def _shard(shards: int):
    return F.pmod(F.shiftrightunsigned("h1", 20), F.lit(shards))


def build_index(lines: DataFrame) -> tuple[str, int]:
    """Write the index of hashed lines; returns its folder and its number of shards."""
    spark = lines.sparkSession
    # how many rows hold the line, and the smallest document
    keys = lines.groupBy("h1", "h2").agg(F.count_if("first").alias("n"), F.min("doc").alias("owner"))
    keys = write_and_read(keys, "lines")
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    folder = fresh_folder(spark, "lineindex")

    def shard(table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        n, owner = table.column("n").to_numpy(), table.column("owner").to_numpy()
        # the 64 bits that place a key; equal ones with different h2 cannot both be placed
        key, first = np.unique(h1, return_index=True)
        rest = np.setdiff1d(np.arange(len(h1)), first)
        levels = build_mph(key)
        slot = probe_mph(levels, level_ranks(levels), key)
        prints, counts, owners = np.empty(len(key), np.uint64), np.empty(len(key), np.uint32), np.empty(len(key), np.int64)
        prints[slot], counts[slot], owners[slot] = h2[first], np.minimum(n[first], MOST_COUNT), owner[first]
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()),
            "sizes": pa.array([[len(b) for b in levels]], pa.list_(pa.int64())),
            "bits": pa.array([b"".join(np.packbits(b).tobytes() for b in levels)], pa.binary()),
            "prints": pa.array([prints.tobytes()], pa.binary()),
            "counts": pa.array([counts.tobytes()], pa.binary()),
            "owners": pa.array([owners.tobytes()], pa.binary()),
            "rest": pa.array([np.stack([h1[rest], h2[rest], owner[rest].view(np.uint64)], 1).tobytes()], pa.binary()),
        })

    schema = "shard bigint, sizes array<bigint>, bits binary, prints binary, counts binary, owners binary, rest binary"
    built = keys.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(shard, schema)
    # a row group for each shard, so that one can be read without the others
    placed = built.withColumn("block", F.floor(F.col("shard") / BLOCK_SHARDS))
    placed.write.partitionBy("block").option("parquet.block.size", 1 << 16).option("compression", "zstd").parquet(folder)
    return folder, shards


class Shard:
    """Bit sets and arrays of one shard, loaded from the shared folder."""

    def __init__(self, folder: str, number: int, block_shards: int):
        store, path = open_store(f"{folder}/block={number // block_shards}")
        found = pq.read_table(path, filesystem=store, filters=[("shard", "=", number)], partitioning=None).to_pylist()
        row = found[0]
        raw, self.levels, at = np.frombuffer(row["bits"], np.uint8), [], 0
        for size in row["sizes"]:
            end = at + -(-size // 8)
            self.levels.append(np.unpackbits(raw[at:end], count=size).astype(bool))
            at = end
        self.ranks = level_ranks(self.levels)
        self.prints, self.counts, self.owners = (np.frombuffer(row[c], t) for c, t in (("prints", np.uint64), ("counts", np.uint32), ("owners", np.int64)))
        self.rest = {(a, b): c for a, b, c in np.frombuffer(row["rest"], np.uint64).reshape(-1, 3).tolist()}

    def smaller_holder(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a line is held by several documents and a smaller one than this is among them."""
        slot = probe_mph(self.levels, self.ranks, h1)
        hit = (slot >= 0) & (self.prints[slot] == h2) if len(self.prints) else np.zeros(len(h1), bool)
        out = np.zeros(len(h1), bool)
        out[hit] = (self.counts[slot[hit]] > 1) & (self.owners[slot[hit]] < doc[hit])
        if self.rest:
            for i in np.flatnonzero(~hit):
                out[i] = self.rest.get((int(h1[i]), int(h2[i])), NO_DOC) < doc[i]
        return out


def dropped_lines(lines: DataFrame, folder: str, shards: int) -> DataFrame:
    """(file, row, lines): the numbers of the lines that go, for every row that loses some."""
    block_shards = BLOCK_SHARDS

    def probe(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        for frame in frames:
            of = frame.column("shard").to_numpy()
            h1, h2 = (frame.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
            doc, gone = frame.column("doc").to_numpy(), np.zeros(len(of), bool)
            for own in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1) if len(of) else []:
                if number != of[own[0]]:
                    number = int(of[own[0]])
                    shard = Shard(folder, number, block_shards)
                gone[own] = shard.smaller_holder(h1[own], h2[own], doc[own])
            if gone.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(gone)) for c in frame.columns[:3]], names=["file", "row", "line"])

    share = F.pmod(F.xxhash64("file", "row"), F.lit(PROBE_PARTS))
    placed = lines.select("file", "row", "line", "h1", "h2", "doc", _shard(shards).alias("shard"))
    dealt = placed.repartition(F.floor(F.col("shard") / BLOCK_SHARDS), share).sortWithinPartitions("shard")
    gone = dealt.mapInArrow(probe, "file bigint, row bigint, line int")
    # as long as the lines of one text
    return gone.groupBy("file", "row").agg(F.collect_list("line").alias("lines"))


class Masks:
    """Places of dropped lines of one input file; a worker keeps those of the last file."""

    kept: tuple[tuple, "Masks"] | None = None

    def __init__(self, folder: str, file: int):
        store, path = open_store(folder)
        found = None
        if store.get_file_info(path).type != fs.FileType.NotFound:
            found = pq.read_table(path, filesystem=store, filters=[("file", "=", file)], partitioning=None, columns=["row", "lines"])
        self.at = {} if found is None else {int(r): i for i, r in enumerate(found.column("row").to_numpy())}
        self.lines = None if found is None else found.column("lines")

    def of(self, row: int) -> list[int]:
        at = self.at.get(row)
        return [] if at is None else self.lines[at].as_py()

    @classmethod
    def load(cls, folder: str, file: int) -> "Masks":
        if cls.kept is None or cls.kept[0] != (folder, file):
            cls.kept = None
            cls.kept = ((folder, file), cls(folder, file))
        return cls.kept[1]


def placed_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_tw_file`` and ``_tw_row``, which stay the same whenever it is read. What is not read from Parquet files as it stands is written first."""
    columns = [F.col(c) for c in docs.columns]
    file, row = F.xxhash64("_metadata.file_path").alias("_tw_file"), F.col("_metadata.row_index").alias("_tw_row")
    try:
        placed = docs.select(*columns, file, row)
        placed.schema  # resolves the names
        return placed
    except AnalysisException:
        return write_and_read(docs, "docs").select(*columns, file, row)


def drop_shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """``docs`` with ``text`` freed of the lines whose key a smaller document holds, and counts ``_tw_lines``, ``_tw_dropped``.

    The key of a line is the line stripped of white space, A-Z in lower case; keys under ``min_key`` code
    points never count. All copies in the smallest document stay. A null or empty text is one empty line
    and stays empty; a null id counts as larger than any other; repeated rows of one id are one document;
    other columns pass through, but one named like the two counts is refused; an empty table gives an empty table. The places of the lines that one input file loses
    are held by a task.
    """
    clash = {"_tw_lines", "_tw_dropped", "_tw_file", "_tw_row"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns named like results: {sorted(clash)}")
    placed = placed_rows(docs)
    lines = write_and_read(hashed_lines(placed, doc_id, text, min_key), "hashes")
    folder, shards = build_index(lines)
    masks = fresh_folder(docs.sparkSession, "masks")
    gone = dropped_lines(lines, folder, shards).withColumn("part", F.pmod("file", F.lit(MASK_FOLDERS)))
    gone = gone.repartition("part", F.floor(F.col("row") / MASK_ROWS)).sortWithinPartitions("part", "file", "row")
    gone.write.partitionBy("part").option("compression", "zstd").parquet(masks)

    def without(texts: pa.Array, files: pa.Array, rows: pa.Array) -> pa.Array:
        kept, counts, dropped = [], [], []
        for t, file, row in zip(texts.to_pylist(), files.to_pylist(), rows.to_pylist()):
            parts = (t or "").split("\n")
            lost = set(Masks.load(f"{masks}/part={file % MASK_FOLDERS}", file).of(row))
            counts.append(len(parts))
            dropped.append(len(lost))
            kept.append("\n".join(p for i, p in enumerate(parts) if i not in lost) if lost else t)
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=["text", "n_lines", "n_dropped"]
        )

    # not evaluated anew for each use of its result
    cut = F.arrow_udf(without, "struct<text:string,n_lines:bigint,n_dropped:bigint>").asNondeterministic()
    done = placed.withColumn("_tw_r", cut(F.col(text), F.col("_tw_file"), F.col("_tw_row")))
    r = F.col("_tw_r")
    return done.select(
        *(r["text"].alias(c) if c == text else F.col(c) for c in docs.columns),
        r["n_lines"].alias("_tw_lines"), r["n_dropped"].alias("_tw_dropped"),
    )


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    cleaned = drop_shared_lines(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return cleaned.select(
        "doc_id", F.col("_tw_lines").alias("n_lines"), F.col("_tw_dropped").alias("n_dropped"),
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"),
    )
