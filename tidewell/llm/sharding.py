"""Shards of even size that keep linked documents together, by balanced label propagation.

The few groups that take much of a shard or more are set first, in as few shards as hold them. The members of all others
start dealt evenly over the room left. In every round each block of linked documents (the members of
one group that share a shard) asks to move where most of its group is, or, while that shard is full, to the shard with room that holds most of it. A shard takes in only what its quota leaves
free and what other blocks hand back in exchange, largest gains first. Groups that the rounds leave cut, as the shard they
ask for is full, are laid anew into the room beside the whole ones. Blocks are counts, so a group of any
size is at most one row for each shard. Documents without links fill the shards up at the end, so
that the numbers of rows differ by at most one.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import write_and_read
from tidewell.operators.attach import attach
from tidewell.operators.ordered import number_rows, running_sums

SHARDS = 40
#: Most rounds; a round without moves ends them before.
ROUNDS = 8
#: Groups of more than a shard's rows by this are set first; there are fewer than ``shards`` times as many.
LARGE = 4
BLOCK = "g string, shard int, n bigint"


def measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, size, text_crc32, g): one narrow row per document; g names its group, the documents with the same text."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        (F.octet_length(raw).cast("bigint") + 16).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.sha2(raw, 256).alias("g"),
    )


def capacities(rows: int, shards: int) -> list[int]:
    """Rows of every shard: at most one apart, the first ones larger."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def number_at(values: list[int], at: Column) -> Column:
    """The value at a position, for at most a few for each shard."""
    return F.array(*(F.lit(v).cast("bigint") for v in values))[at]


def loads(blocks: DataFrame, shards: int) -> list[int]:
    """Rows of the blocks in every shard."""
    found = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(i, 0) for i in range(shards)]


def fitted(groups: list[tuple[str, int]], room: list[int]) -> list[tuple[str, int, int]]:
    """(g, shard, n) of a bounded list of groups (g, n), largest first, in the fewest shards whose ``room`` holds them; takes that room.

    A group goes where least room is left beside it; one that fits nowhere fills the largest room, and the rest of it takes its turn again.
    """
    out = []
    heap = [(-n, g) for g, n in groups]
    heapq.heapify(heap)
    while heap:
        n, g = heapq.heappop(heap)
        fits = [i for i, r in enumerate(room) if r >= -n]
        shard = min(fits, key=lambda i: (room[i], i)) if fits else max(range(len(room)), key=lambda i: (room[i], -i))
        taken = min(-n, room[shard])
        room[shard] -= taken
        out.append((g, shard, taken))
        if taken < -n:
            heapq.heappush(heap, (n + taken, g))
    return out


def propagate(blocks: DataFrame, room: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Move blocks (g, shard, n) towards the shard that holds most of their group; never more rows in a shard than its room.

    The input must keep to the room. A block may move in part.
    """
    group = Window.partitionBy("g")
    for _ in range(rounds):
        load = blocks.groupBy("shard").agg(F.sum("n").alias("load"))
        now = loads(blocks, len(room))
        # room that is left, also for the whole of a group: of several shards with it the one that holds most is asked
        spare = number_at([r - n for r, n in zip(room, now)], F.col("shard"))
        held = blocks.withColumn("open", spare >= F.sum("n").over(group) - F.col("n"))
        # a group has at most one block for each shard, so this window is small
        best = F.max(F.struct("open", "n", F.hash("g", "shard"), "shard")).over(group)
        asked = (
            held.withColumn("to", best["shard"]).withColumn("gain", best["n"] - F.col("n"))
            .where(F.col("to") != F.col("shard"))
        )
        asked = write_and_read(asked.select("g", F.col("shard").alias("src"), F.col("to").alias("dst"), "n", "gain"), "asked")
        # shards x shards rows
        wanted = asked.groupBy("src", "dst").agg(F.sum("n").alias("want"))
        back = wanted.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("want").alias("back"))
        table = wanted.join(back, ["src", "dst"], "left").withColumn("swap", F.least("want", F.coalesce("back", F.lit(0))))
        into = Window.partitionBy("dst").orderBy(F.desc("more"), "src").rowsBetween(Window.unboundedPreceding, -1)
        free = number_at(room, F.col("shard")) - F.col("load")
        table = (
            table.join(load.select(F.col("shard").alias("dst"), free.alias("free")), "dst", "left")
            .withColumn("free", F.coalesce("free", number_at(room, F.col("dst"))))
            .withColumn("more", F.col("want") - F.col("swap"))
            .withColumn("given", F.coalesce(F.sum("more").over(into), F.lit(0)))
            .withColumn("quota", F.col("swap") + F.greatest(F.lit(0), F.least(F.col("more"), F.col("free") - F.col("given"))))
            .select("src", "dst", "quota")
        )
        # two blocks that swap must move the same number of rows, so the quota is filled to the row, the last block in part
        lined = running_sums(asked, ["src", "dst"], [F.desc("gain"), F.asc("g")], {"upto": F.col("n")})
        moved = (
            lined.join(F.broadcast(table), ["src", "dst"])  # shards x shards rows
            .withColumn("moved", F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - (F.col("upto") - F.col("n")))))
            .where("moved > 0")
            .select("g", "src", "dst", "moved")
        )
        moved = write_and_read(moved, "moved")
        if moved.isEmpty():
            break
        change = moved.select("g", F.col("src").alias("shard"), (-F.col("moved")).alias("n")).union(
            moved.select("g", F.col("dst").alias("shard"), F.col("moved").alias("n"))
        )
        blocks = write_and_read(blocks.union(change).groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "blocks")
    return blocks


def cut_groups(blocks: DataFrame) -> tuple[int, int]:
    """(groups that lie in several shards, groups)."""
    parts = blocks.groupBy("g").agg(F.count("*").alias("parts"))
    cut, n = parts.agg(F.count_if(F.col("parts") > 1), F.count("*")).first()
    return cut, n


def whole_groups(blocks: DataFrame, room: list[int]) -> DataFrame:
    """The blocks with all groups that are still cut laid anew, one after the other, into the room that the others leave.

    Fewer groups than shards come to lie across an edge of a shard; these go where one of the shards still holds them whole, and
    are cut only if none does.
    """
    spark, shards = blocks.sparkSession, len(room)
    sizes = write_and_read(
        blocks.groupBy("g").agg(F.min("shard").alias("shard"), F.sum("n").alias("n"), F.count("*").alias("parts")), "sizes"
    )
    whole = sizes.where("parts = 1").select("g", "shard", "n")
    cut = sizes.where("parts > 1").select("g", "n")
    if cut.isEmpty():
        return blocks
    left = [r - n for r, n in zip(room, loads(whole, shards))]
    line = sorted(range(shards), key=lambda i: (-left[i], i))
    edges = [sum(left[i] for i in line[: k + 1]) for k in range(shards)]
    lined = running_sums(cut, [], [F.desc("n"), F.asc("g")], {"upto": F.col("n")})

    def place(row: Column) -> Column:
        return F.size(F.filter(F.array(*(F.lit(e).cast("bigint") for e in edges)), lambda e: e <= row))

    lined = write_and_read(
        lined.select("g", "n", place(F.col("upto") - F.col("n")).alias("first"), place(F.col("upto") - 1).alias("last")), "lined"
    )
    laid = lined.where("first = last").select("g", number_at(line, F.col("first")).cast("int").alias("shard"), "n")
    across = [(r["g"], r["n"]) for r in lined.where("first < last").collect()]  # fewer than shards
    left = [r - n for r, n in zip(left, loads(laid, shards))]
    return whole.union(laid).union(spark.createDataFrame(fitted(across, left), BLOCK))


def dealt_evenly(position: Column, rows: int, room: list[int]) -> Column:
    """Shard of the document at a position (from 0) of all ``rows``: runs in proportion to the room, never longer than it."""
    total = max(sum(room), 1)
    ends = [rows * sum(room[: i + 1]) // total for i in range(len(room))]
    return F.size(F.filter(F.array(*(F.lit(e).cast("bigint") for e in ends)), lambda e: e <= position))


def shards_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: size, crc, ``law`` rows, ``shard``, and a gapless ``slot`` in it.

    Numbers of rows differ by at most one. Documents with equal texts, null and empty ones too, are linked; a group larger
    than a shard is cut only as often as it must be, a smaller one only where no shard has room for it beside groups set before. Rows without an id come first, ties are
    broken by the text's hash, repeated rows get a slot each; other columns are not read; an empty table gives an empty table.
    """
    rows = write_and_read(measured(docs, doc_id, text), "measured")
    total = rows.count()
    order = [F.col("doc_id").asc_nulls_first(), F.col("g").asc()]
    if total == 0:
        return _named(rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("bigint")}))
    many = write_and_read(rows.groupBy("g").agg(F.count("*").alias("copies")).where("copies > 1"), "groups")
    known = write_and_read(attach(rows, many, ["g"], weight="copies"), "known")
    linked = known.where("copies IS NOT NULL")
    single = known.where("copies IS NULL").drop("copies")

    # large groups are set first, whole or in whole shards
    caps = capacities(total, shards)
    limit = total // shards // LARGE
    large = [(r["g"], r["copies"]) for r in many.where(F.col("copies") > limit).collect()]  # at most shards * LARGE and a few on tiny tables
    room = list(caps)
    set_first = fitted(large, room)

    # the start: all other linked documents dealt evenly in the order of their ids
    small = linked.where(F.col("copies") <= limit).drop("copies")
    linked = linked.drop("copies")
    n_small = small.count()
    start = number_rows(small, [], order, "at").groupBy("g", dealt_evenly(F.col("at") - 1, n_small, room).alias("shard")).agg(F.count("*").alias("n"))
    gathered = whole_groups(propagate(write_and_read(start, "blocks"), room, rounds), room)
    blocks = write_and_read(gathered.union(docs.sparkSession.createDataFrame(set_first, BLOCK)), "blocks")

    # members of a group take its blocks in order; a block's rows are a run of slots of its shard
    slots = running_sums(blocks, ["shard"], [F.asc("g")], {"slot_end": F.col("n")})
    runs = slots.withColumn("end", F.sum("n").over(Window.partitionBy("g").orderBy("shard")))
    per_group = runs.groupBy("g").agg(
        F.sum("n").alias("members"),
        F.sort_array(F.collect_list(F.struct("end", "shard", "n", "slot_end"))).alias("runs"),  # at most one for each shard
    )
    numbered = number_rows(linked, ["g"], [F.col("doc_id").asc_nulls_first()], "at")
    mine = attach(numbered, write_and_read(per_group, "runs"), ["g"], weight="members")
    run = F.filter("runs", lambda r: r["end"] >= F.col("at"))[0]
    placed = mine.withColumn("run", run).select(
        "doc_id", "size", "text_crc32", F.col("run.shard").alias("shard"),
        (F.col("run.slot_end") - (F.col("run.end") - F.col("at")) - 1).alias("slot"),
    )

    # documents without links fill the shards; one row for each shard
    load = loads(blocks, shards)
    filled = F.lit(None).cast("struct<shard:int,slot:bigint>")
    begin = 0
    position = F.col("at") - 1
    for shard, cap in reversed(list(enumerate(caps))):
        free = cap - load[shard]
        value = F.struct(F.lit(shard).alias("shard"), (position - begin + load[shard]).alias("slot"))
        filled = F.when((position >= begin) & (position < begin + free), value).otherwise(filled)
        begin += free
    fill = number_rows(single, [], order, "at").withColumn("f", filled)
    placed_single = fill.select("doc_id", "size", "text_crc32", F.col("f.shard").alias("shard"), F.col("f.slot").alias("slot"))
    return _named(placed.union(placed_single))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
