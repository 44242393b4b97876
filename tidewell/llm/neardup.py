"""Near-duplicate documents: MinHash bands propose, odd sketches sift, full shingle sets decide.

Documents with equal shingle sets are one node. Each band bucket links its members to its smallest
node only. An odd sketch is a bitmap in which every MinHash sample of a node flips one bit; the bits in
which two sketches differ count the samples that differ, most precisely where similarity is high.
What passes is confirmed on the full sets, first one partner per node. Where nodes of one cluster then still
lie in different components, ``within_clusters`` finds the pairs that could join them, so no such link is
left out, while large groups of near copies cost a few comparisons per node and not all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import FEW, SOME, size_checked, strings, write_and_read
from tidewell.llm.graph import connected
from tidewell.operators.attach import attach

#: 50 bands of 6 samples: two sets of similarity 0.8 share a band with probability 1 - 2.5e-7.
BANDS, ROWS = 50, 6
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch.
BITS = 1024
#: Pairs whose estimate is lower are dropped. At similarity 0.8 the estimate has a deviation of 0.04, so this is 5 of them.
LEAST_ESTIMATE = 0.6
#: Words whose hashes a worker keeps; more of them would not fit its processor's cache.
CACHE_WORDS = 20_000
#: Pairs of different clusters that one band bucket may make. The members of a bucket that would make more are joined on the items that set them apart.
MOST_PAIRS = 1_000_000
#: So many node ids at most are broadcast (about 50 bytes each); beyond, texts are shuffled by document.
MAX_BROADCAST_NODES = 200_000

#: Ids are below; see ``row_id``.
NO_ID = 1 << 62

_U = np.uint64


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHashes()


def _final(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingle_set(text: str, words_per_shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than one shingle count as one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n, k = len(words), words_per_shingle
    if not n:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    k = min(k, n)
    with np.errstate(over="ignore"):
        rolled = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            rolled = rolled * _U(0x9E3779B97F4A7C15) + hashes[i : n - k + 1 + i]
        return np.unique(_final(rolled))


def _seeds(count: int, salt: int) -> np.ndarray:
    return np.random.RandomState(salt).randint(0, 1 << 32, count, np.uint64).astype(np.uint32)


_A, _B = _seeds(SAMPLES, 11) | np.uint32(1), _seeds(SAMPLES, 12)


def minhash(items: np.ndarray) -> np.ndarray:
    """The smallest value of every sample function over a set that is not empty."""
    x = (items >> _U(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 1024):
            values = _A[:, None] * x[None, at : at + 1024]
            values += _B[:, None]
            np.minimum(best, values.min(axis=1), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        table = samples.reshape(BANDS, ROWS).astype(np.uint64)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(ROWS):
            key = _final(key * _U(0x9E3779B97F4A7C15) + table[:, i])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of the number of samples on every bit, packed in 64-bit words."""
    with np.errstate(over="ignore"):
        spot = _final((np.arange(1, SAMPLES + 1, dtype=np.uint64) << _U(32)) | samples.astype(np.uint64)) % _U(BITS)
    odd = np.bincount(spot.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<u8").view(np.int64)


def most_bits_apart(estimate: float) -> int:
    """Differing bits at which the estimate 1 + bits / (4 samples) * ln(1 - 2 z / bits) falls to ``estimate``."""
    return math.floor(BITS / 2 * (1 - math.exp(-(1 - estimate) * 4 * SAMPLES / BITS)))


def bits_apart(x: Column, y: Column) -> Column:
    return reduce(lambda s, i: s + F.bit_count(x[i].bitwiseXOR(y[i])), range(1, BITS // 64), F.bit_count(x[0].bitwiseXOR(y[0])))


def row_id(doc_id: str, text: str) -> Column:
    """The id, or a hash of the text above all ids for rows without one."""
    return F.coalesce(F.col(doc_id).cast("bigint"), F.xxhash64(text).bitwiseAND(NO_ID - 1).bitwiseOR(F.lit(NO_ID)))


def sketched(docs: DataFrame, doc_id: str, text: str, words_per_shingle: int, hashed: bool = False) -> DataFrame:
    """(doc_id, rid, n, d1, d2, odd, bands): set size, digest of the set, odd sketch and band keys; nulls after n for empty sets.

    ``hashed`` adds ``text_hash``.
    """
    ddl = "doc_id bigint, rid bigint, n bigint, d1 bigint, d2 bigint, odd array<bigint>, bands array<bigint>" + ", text_hash bigint" * hashed

    def sketch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            sizes, digests, odds, bands = [], [], [], []
            for t in strings(frame.column(2)):
                items = shingle_set(t, words_per_shingle)
                sizes.append(len(items))
                if not len(items):
                    digests.append((None, None))
                    odds.append(None)
                    bands.append(None)
                    continue
                digest = xxhash.xxh3_128_digest(items.tobytes())
                digests.append(tuple(np.frombuffer(digest, "<i8").tolist()))
                samples = minhash(items)
                odds.append(odd_sketch(samples))
                bands.append(band_keys(samples))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), frame.column(1), pa.array(sizes, pa.int64()), pa.array([d for d, _ in digests], pa.int64()),
                 pa.array([d for _, d in digests], pa.int64()), pa.array(odds, longs), pa.array(bands, longs), *(frame.column(3 + i) for i in range(hashed))],
                names=["doc_id", "rid", "n", "d1", "d2", "odd", "bands", *["text_hash"] * hashed],
            )

    extra = [F.xxhash64(text).alias("text_hash")] if hashed else []
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), row_id(doc_id, text).alias("rid"), F.col(text), *extra).mapInArrow(sketch, ddl)


def full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, words_per_shingle: int) -> DataFrame:
    """(nid, items) of the ``wanted`` nodes (nid, label, d1, d2), from the texts of their labels."""
    few = size_checked(wanted, MAX_BROADCAST_NODES)
    named = wanted.select("nid", "label", F.col("d1").alias("w1"), F.col("d2").alias("w2"))
    texts = docs.select(row_id(doc_id, text).alias("label"), F.col(text).alias("text"))
    held = texts.join(F.broadcast(named) if few else named, "label").select("nid", "w1", "w2", "text")
    ddl = "nid bigint, items array<bigint>"

    def sets(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            nids, items = [], []
            for nid, w1, w2, t in zip(*(frame.column(i).to_pylist() for i in range(4))):
                found = shingle_set(t or "", words_per_shingle)
                # rows that share an id may hold other texts
                if tuple(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8").tolist()) == (w1, w2):
                    nids.append(nid)
                    items.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nids, pa.int64()), pa.array(items, pa.list_(pa.int64()))], names=["nid", "items"])

    return held.mapInArrow(sets, ddl).dropDuplicates(["nid"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    x = sets.select(F.col("nid").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("nid").alias("b"), F.col("items").alias("y"))
    # merged, not hashed: rows with whole sets must be able to spill
    both = pairs.select("a", "b").join(y.hint("merge"), "b").join(x.hint("merge"), "a")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared * (100 + percent) >= (F.size("x") + F.size("y")) * percent).select("a", "b")


def within_clusters(known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components of one cluster (nid, g, comp), or of one crowded bucket, that may reach the similarity; none that do are left out.

    Two sets reach it if at most share * (sizes added up) items differ, share = (100 - percent) / (100 + percent). All sets of
    a cluster are compared with its centre, the items that more than half of them hold: D is what a set has otherwise. With
    f = |D| - share * size, sets with f(x) + f(y) <= 0 are surely similar, so all of them are tied to the set with the
    smallest f. Any other similar pair must share (f(x) + f(y)) / 2 items of its Ds, hence one of the rarest of each:
    only those items are joined. Sets that differ from the centre each in their own way meet nobody.
    """
    up, down = 100 - percent, 100 + percent  # f in units of 1 / down
    mixed = known.groupBy("g").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m")).where("c0 < c1").select("g", "m")
    rows = write_and_read(known.join(mixed, "g").join(sets.hint("merge"), "nid"), "mixed", few=FEW)
    held = rows.select("g", F.explode("items").alias("e")).groupBy("g", "e").agg(F.count("*").alias("n"))
    # at most twice as many items as a set of the cluster has on average
    centre = held.join(mixed, "g").where(F.col("n") * 2 > F.col("m")).groupBy("g").agg(F.collect_list("e").alias("centre"))
    none = F.array().cast("array<bigint>")
    other = F.concat(F.array_except("items", F.col("centre")), F.array_except(F.col("centre"), "items"))
    apart = rows.join(centre, "g", "left").withColumn("centre", F.coalesce("centre", none)).select(
        "nid", "g", "comp", F.size("items").cast("bigint").alias("n"), other.alias("d"), F.size(other).cast("bigint").alias("nd")
    )
    f = F.col("nd") * down - F.col("n") * up
    apart = write_and_read(apart.withColumn("f", f), "apart", few=FEW)
    middle = apart.groupBy("g").agg(F.min(F.struct("f", "nid")).alias("mid")).select("g", F.col("mid.f").alias("f0"), F.col("mid.nid").alias("c"))
    judged = apart.join(middle, "g").withColumn("far", F.col("f") + F.col("f0") > 0)
    tied = judged.where(~F.col("far") & (F.col("nid") != F.col("c"))).select(F.least("nid", "c").alias("a"), F.greatest("nid", "c").alias("b"))

    # a partner of a far set has f0 at least, one of a near set more than -f0
    partner = F.when(F.col("far"), F.col("f0")).otherwise(1 - F.col("f0"))
    shared = F.greatest(F.lit(1), F.ceil((F.col("f") + partner) / (2 * down)))
    items = judged.select("nid", "g", "comp", "n", "f", "far", (F.col("nd") - shared + 1).alias("first"), "nd", F.explode("d").alias("e"))
    # an item that one component alone holds is shared with no partner
    often = items.groupBy("g", "e").agg(F.count("*").alias("df"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("g", "e", "df")
    common = items.join(often, ["g", "e"])
    # items of one set: those that no set of another component has come first and need no row
    own = Window.partitionBy("g", "nid")
    place = F.col("nd") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "e"))
    ranked = common.withColumn("place", place).where(F.col("place") <= F.col("first"))
    first = write_and_read(ranked.select("g", "e", "nid", "comp", "n", "f", "far", (F.col("nd") - F.col("place")).alias("after")), "rare", few=FEW)
    x = first.where("far").select("g", "e", *(F.col(c).alias(f"x_{c}") for c in ("nid", "comp", "n", "f", "after")))
    y = first.select("g", "e", *(F.col(c).alias(f"y_{c}") for c in ("nid", "comp", "n", "f", "after", "far")))
    # the first item that a pair shares leaves room, in what comes after it, for all the others that it must share
    room = F.least("x_after", "y_after") + 1 >= F.ceil((F.col("x_f") + F.col("y_f")) / (2 * down))
    near_enough = F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent
    once = ~F.col("y_far") | (F.col("x_nid") < F.col("y_nid"))
    met = x.join(y, ["g", "e"]).where((F.col("x_comp") != F.col("y_comp")) & near_enough & once & room)
    return tied.union(met.select(F.least("x_nid", "y_nid").alias("a"), F.greatest("x_nid", "y_nid").alias("b"))).distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_per_shingle: int = 5, percent: int = 80, hashed: bool = False
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id of its group) and ``kept``.

    Words are split at white space, A-Z in lower case. Texts without words, null or empty, have an empty set and
    are linked with nothing. Equal sets are always linked. Repeated rows give a row each. A null id
    counts as larger than any other; ``kept`` says whether the id is that of its group. An empty table gives an
    empty table, other columns are not read, texts of any length are taken whole. ``hashed`` adds ``text_hash``, the text's
    xxhash64, and ``comp``, which tells groups apart that have the same smallest id; null for a set of one row that is alone.
    """
    rows = write_and_read(sketched(docs, doc_id, text, words_per_shingle, hashed), "sketch")
    nodes = (
        rows.where("n > 0")
        .groupBy("d1", "d2")
        .agg(F.min("rid").alias("label"), F.count("*").alias("copies"), F.first(F.struct("n", "odd", "bands")).alias("s"))
        .select(F.monotonically_increasing_id().alias("nid"), "d1", "d2", "label", "copies", "s.*")
    )
    nodes = write_and_read(nodes, "nodes", few=SOME)

    keyed = nodes.select("nid", F.explode("bands").alias("h"))
    buckets = keyed.groupBy("h").agg(F.min("nid").alias("pivot"), F.max("nid").alias("last")).where("pivot < last").select("h", "pivot")
    members = write_and_read(keyed.join(buckets, "h"), "members", few=SOME)

    def sifted(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Pairs whose sizes and odd sketches allow the similarity, with the bits they are apart."""
        x = sketches.select(F.col("nid").alias("a"), F.col("n").alias("nx"), F.col("odd").alias("ox"))
        y = sketches.select(F.col("nid").alias("b"), F.col("n").alias("ny"), F.col("odd").alias("oy"))
        return (
            pairs.join(y, "b").join(x, "a")
            .where(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)
            .select("a", "b", bits_apart(F.col("ox"), F.col("oy")).alias("z"))
            .where(F.col("z") <= most_bits_apart(LEAST_ESTIMATE))
        )

    sketches = nodes.select("nid", "n", "odd")
    spokes = members.where("pivot < nid").select(F.col("pivot").alias("a"), F.col("nid").alias("b")).distinct()
    spokes = write_and_read(sifted(spokes, sketches), "spokes", few=FEW)
    first = spokes.groupBy("b").agg(F.min(F.struct("z", "a")).alias("best")).select("best.a", "b")

    # every node that shares a bucket and may be compared
    busy = spokes.select(F.col("a").alias("nid")).union(spokes.select("b")).distinct()

    def sets_of(some: DataFrame, label: str) -> DataFrame:
        wanted = nodes.select("nid", "label", "d1", "d2").join(some, "nid", "left_semi")
        return write_and_read(full_sets(docs, wanted, doc_id, text, words_per_shingle), label, few=SOME)

    sets = sets_of(busy, "sets")
    links = write_and_read(confirmed(first, sets, percent), "links", few=FEW)
    comps = connected(links)

    # candidates that could still join two components: within a cluster of similar nodes, and across clusters
    clusters = connected(spokes)
    known = clusters.select(F.col("node").alias("nid"), F.col("comp").alias("g")).join(comps.withColumnRenamed("node", "nid"), "nid", "left")
    known = write_and_read(known.withColumn("comp", F.coalesce("comp", "nid")), "known", few=FEW)
    inside = within_clusters(known, sets, percent)
    placed = members.select("h", "nid").join(known, "nid", "left").withColumns({"g": F.coalesce("g", "nid"), "comp": F.coalesce("comp", "nid")})
    placed = write_and_read(placed, "placed", few=SOME)
    split = placed.groupBy("h").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 < g1").select("h")
    mixed = write_and_read(placed.join(split, "h", "left_semi").select("h", "nid", "g", "comp"), "open", few=SOME)
    n = F.col("n").cast("double")
    sizes = mixed.groupBy("h", "g").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum(n).alias("all"), F.sum(n * n).alias("own"))
    # members that pairs of different clusters would number, twice
    crowded = write_and_read(sizes.where(F.col("all") * F.col("all") - F.col("own") > 2.0 * MOST_PAIRS).select("h"), "crowded", few=FEW)
    if not crowded.isEmpty():
        members_of = write_and_read(mixed.join(crowded, "h").select("nid", F.col("h").alias("g"), "comp"), "crowd", few=SOME)
        others = members_of.select("nid").distinct().join(busy, "nid", "left_anti")
        sets = sets.union(sets_of(others, "crowdsets"))
        busy = busy.union(others)
        inside = inside.union(within_clusters(members_of, sets, percent)).distinct()
    open_members = mixed.join(crowded, "h", "left_anti").select("h", "nid", "g").join(sketches, "nid")
    x = open_members.select("h", *(F.col(c).alias(f"x_{c}") for c in ("nid", "g", "n", "odd")))
    y = open_members.select("h", *(F.col(c).alias(f"y_{c}") for c in ("nid", "g", "n", "odd")))
    across = (
        x.join(y, (x["h"] == y["h"]) & (F.col("x_g") < F.col("y_g")) & (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent))
        .where(bits_apart(F.col("x_odd"), F.col("y_odd")) <= most_bits_apart(LEAST_ESTIMATE))
        .select(F.least("x_nid", "y_nid").alias("a"), F.greatest("x_nid", "y_nid").alias("b"))
    )
    rest = write_and_read(sifted(inside, sketches).select("a", "b").union(across).distinct(), "rest", few=FEW)
    more = rest.select(F.col("a").alias("nid")).union(rest.select("b")).distinct().join(busy, "nid", "left_anti")
    all_sets = sets.union(sets_of(more, "moresets"))
    extra = write_and_read(confirmed(rest, all_sets, percent), "links", few=FEW)
    comps = connected(links.union(extra))

    grouped = nodes.select("nid", "d1", "d2", "label", "copies").join(comps.withColumnRenamed("node", "nid"), "nid", "left")
    grouped = grouped.withColumn("comp", F.coalesce("comp", "nid"))
    size = [F.count("*").alias("nodes")] if hashed else []
    named = grouped.groupBy("comp").agg(F.min("label").alias("component_id"), *size)
    told = (F.col("copies") > 1) | ~F.col("label").eqNullSafe(F.col("component_id"))
    per_set = (
        grouped.join(named, "comp")
        .where(told | (F.col("nodes") > 1) if hashed else told)
        .select("d1", "d2", "copies", "component_id", *["comp"] * hashed)
    )
    marked = attach(rows.select("doc_id", "n", "d1", "d2", *["text_hash"] * hashed), write_and_read(per_set, "groups", few=FEW), ["d1", "d2"], weight="copies")
    component = F.when(F.col("component_id") < NO_ID, F.col("component_id")).when(F.col("component_id").isNull(), F.col("doc_id"))
    return marked.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *["text_hash", "comp"] * hashed
    )


def keep_first_of_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words_per_shingle: int = 5) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest id; see ``near_duplicates``.

    Rows are told apart by id and text: of repeated rows one stays; of rows that share an id but not the text, each is judged by its own
    group, and one stays of those that are near duplicates of each other. Rows without an id cannot be told apart and stay.
    """
    marks = write_and_read(near_duplicates(docs, doc_id, text, words_per_shingle, hashed=True), "marks", few=SOME).where("doc_id IS NOT NULL")
    gone = marks.where(~F.col("kept")).select("doc_id", "text_hash")
    twice = marks.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if twice:  # texts of one id that are near duplicates of each other: the one with the smallest hash stays
        own = marks.where("kept AND comp IS NOT NULL").select("doc_id", "comp", "text_hash")
        several = own.groupBy("doc_id", "comp").agg(F.min("text_hash").alias("first"), F.max("text_hash").alias("last")).where("first < last")
        gone = gone.union(own.join(several, ["doc_id", "comp"]).where("text_hash > first").select("doc_id", "text_hash"))
    gone = gone.distinct().select(F.col("doc_id").alias("_tw_gone"), F.col("text_hash").alias("_tw_gone_text"))
    if size_checked(gone, MAX_BROADCAST_NODES):  # else the texts are shuffled by document
        gone = F.broadcast(gone)
    same = (F.col(doc_id).cast("bigint") == F.col("_tw_gone")) & (F.xxhash64(text) == F.col("_tw_gone_text"))
    stay = docs.join(gone, same, "left_anti")
    if twice:
        with_id = stay.where(F.col(doc_id).isNotNull()).withColumn("_tw_text", F.xxhash64(text))
        stay = with_id.dropDuplicates([doc_id, "_tw_text"]).drop("_tw_text").unionByName(stay.where(F.col(doc_id).isNull()))
    return stay
