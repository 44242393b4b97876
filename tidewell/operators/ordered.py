"""Ordered work on groups of any size.

A window partitioned by a key puts the whole key into one task. The functions
here first cut the rows, ordered by (keys, order), into ranges of even size, so
a key that holds a third of the table spans many ranges. Each range computes its
own running values; a small per-range table carries the totals of the ranges
before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import spread, stage

RANGE = "_tw_range"


def split_in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range-partition by (keys, order) and label every row with its range.

    Staged, because range bounds come from a sample and must not be drawn anew
    by the two passes that read the result.
    """
    bounds = [*(F.col(k).asc() for k in keys), *order]
    ranged = df.repartitionByRange(*bounds).withColumn(RANGE, F.spark_partition_id())
    return stage(ranged, "ranges")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running sums of ``sums`` and whole-group sums of ``totals``.

    ``order`` must be a total order within the group for a repeatable result.
    """
    totals = totals or {}
    run = {f"_tw_run{i}": expr for i, expr in enumerate(sums.values())}
    tot = {f"_tw_tot{i}": expr for i, expr in enumerate(totals.values())}
    staged = split_in_ranges(df.withColumns({**run, **tot}), keys, order)

    group_cols = [*keys, RANGE]
    per_range = staged.groupBy(*group_cols).agg(*(F.sum(c).alias(c) for c in [*run, *tot]))
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    spanning = per_range.withColumn("_tw_ranges", F.count("*").over(whole)).select(
        *(F.col(c).alias(f"_tw_on_{c}") for c in group_cols),
        *(F.sum(c).over(earlier).alias(f"{c}_before") for c in run),
        *(F.sum(c).over(whole).alias(f"{c}_all") for c in tot),
        "_tw_ranges",
    ).where(F.col("_tw_ranges") > 1)
    # Ranges follow the key order, so only the first and the last group of a range can
    # reach into another one: at most two rows per range, whatever the number of groups.
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_tw_on_{c}")) for c in group_cols))
    local = Window.partitionBy(*group_cols)
    here = local.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return staged.join(F.broadcast(spanning), on, "left").select(
        *df.columns,
        *(
            F.coalesce(F.col(f"{c}_before") + F.sum(c).over(here), F.sum(c).over(here), F.col(f"{c}_before")).alias(name)
            for name, c in zip(sums, run)
        ),
        *(F.coalesce(F.col(f"{c}_all"), F.sum(c).over(local)).alias(name) for name, c in zip(totals, tot)),
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """1-based position of every row in its group, and the group size on demand.

    Without keys the rows are shuffled once: sorted inside even ranges, they are counted as
    they are written, and a table with one row per range says how many come before.
    """
    one = F.lit(1).cast("bigint")
    if keys:
        return running_sums(df, keys, order, {name: one}, {total: one} if total else None)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(ranged.withColumn("_tw_at", F.monotonically_increasing_id()), "ranges")
    # an id is the number of the range and, in its lower 33 bits, the place in it
    part, place = F.shiftright("_tw_at", 33), F.col("_tw_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_tw_part")).agg(F.count("*").alias("_tw_n"))
    earlier = Window.orderBy("_tw_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(
        "_tw_part", F.coalesce(F.sum("_tw_n").over(earlier), F.lit(0)).alias("_tw_before"), F.sum("_tw_n").over(Window.partitionBy()).alias("_tw_all")
    )
    joined = placed.join(F.broadcast(before), part == F.col("_tw_part"))
    extra = [F.col("_tw_all").alias(total)] if total else []
    return joined.select(*df.columns, (F.col("_tw_before") + place + 1).alias(name), *extra)


PLACE = "_tw_place"


def sorted_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``split_in_ranges`` with the rows of a range sorted and numbered by ``PLACE``."""
    bounds = [*(F.col(k).asc() for k in keys), *order]
    ranged = df.repartitionByRange(*bounds).sortWithinPartitions(*bounds)
    return stage(ranged.withColumns({RANGE: F.spark_partition_id(), PLACE: F.monotonically_increasing_id()}), "ranges")


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Mapping[str, str]) -> DataFrame:
    """Add, for each (name, column), the last value that is not null up to and including the row, in groups of any size.

    A range needs one value of all ranges before it: the last known one at its first group.
    """
    staged = sorted_ranges(df, keys, order)
    group = [*keys, RANGE]
    lasts = {f"_tw_last{i}": c for i, c in enumerate(columns.values())}
    # a struct, so that the value may be one itself
    per_range = staged.groupBy(*group).agg(
        *(F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull(), F.col(PLACE))).alias(n) for n, c in lasts.items())
    )
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    spanning = per_range.withColumn("_tw_ranges", F.count("*").over(Window.partitionBy(*keys))).select(
        *(F.col(c).alias(f"_tw_on_{c}") for c in group), *(F.last(n, ignorenulls=True).over(earlier).alias(f"{n}_before") for n in lasts), "_tw_ranges",
    ).where(F.col("_tw_ranges") > 1)
    # at most two groups of a range reach into another one
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_tw_on_{c}")) for c in group))
    here = Window.partitionBy(*group).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    known = {name: F.coalesce(F.last(c, ignorenulls=True).over(here), F.col(f"{n}_before.v")) for (name, c), n in zip(columns.items(), lasts)}
    kept = [c for c in df.columns if c not in known]
    return staged.join(F.broadcast(spanning), on, "left").select(*kept, *(v.alias(n) for n, v in known.items())).select(
        *df.columns, *(n for n in known if n not in df.columns)
    )


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """At least the last ``n`` rows of every group: no more than ``n`` of each range that the group lies in."""
    staged = sorted_ranges(df, keys, order)
    back = Window.partitionBy(*keys, RANGE).orderBy(F.desc(PLACE))
    return staged.withColumn("_tw_back", F.row_number().over(back)).where(F.col("_tw_back") <= n).select(*df.columns)


#: Accuracy of the sketch that brackets a quantile, and the part of the rows left on each side of it, 12 times the sketch's error.
SKETCH, MARGIN = 4000, 0.003
#: Groups with fewer rows are ordered whole: there the margin is less than a few rows.
LEAST_BRACKETED = 2000


def _counts(df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float], few_groups: bool) -> DataFrame:
    """(keys, _tw_i, _tw_v, _tw_n, _tw_total): how often each value occurs that may matter for level i; a null value stands for all below."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_tw_v"))
    n = F.count("*")
    if not few_groups:
        # every value matters for every level; repeated ones are one row
        counted = rows.groupBy(*keys, "_tw_v").agg(n.alias("_tw_n"))
        totals = F.lit(None).cast("bigint")
        return counted.select(*keys, F.lit(None).cast("int").alias("_tw_i"), "_tw_v", "_tw_n", totals.alias("_tw_total"))
    marks = [max(0.0, f - MARGIN) for f in levels] + [min(1.0, f + MARGIN) for f in levels]
    found = rows.groupBy(*keys).agg(
        n.alias("_tw_total"), F.percentile_approx("_tw_v", marks, SKETCH).alias("_tw_q"),
        F.min("_tw_v").alias("_tw_min"), F.max("_tw_v").alias("_tw_max"),
    )
    small = F.col("_tw_total") < LEAST_BRACKETED
    size = len(levels)
    lows = [F.when(small, F.col("_tw_min")).otherwise(F.get("_tw_q", F.lit(i))) for i in range(size)]
    highs = [F.when(small, F.col("_tw_max")).otherwise(F.get("_tw_q", F.lit(size + i))) for i in range(size)]
    side = found.select(*(F.col(k).alias(f"_tw_k_{k}") for k in keys), "_tw_total", F.array(*lows).alias("_tw_lo"), F.array(*highs).alias("_tw_hi"))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_tw_k_{k}")) for k in keys), F.lit(True))
    joined = rows.join(F.broadcast(side), on)  # one row for each of the few groups
    v = F.col("_tw_v")
    reached = reduce(lambda a, b: a + b, ((F.get("_tw_lo", F.lit(i)) <= v).cast("int") for i in range(size)))
    inside = [
        F.when(v.between(F.get("_tw_lo", F.lit(i)), F.get("_tw_hi", F.lit(i))), F.struct(F.lit(i).alias("_tw_i"), v.alias("_tw_v")))
        for i in range(size)
    ]
    # a row counts once in the region between brackets it lies in, and once in each bracket
    region = F.struct((reached + size).alias("_tw_i"), F.lit(None).cast(df.schema[value].dataType).alias("_tw_v"))
    cells = joined.select(*keys, "_tw_total", F.inline(F.concat(F.array(region), F.array_compact(F.array(*inside)))))
    counted = cells.groupBy(*keys, "_tw_i", "_tw_v").agg(n.alias("_tw_n"), F.max("_tw_total").alias("_tw_total"))
    counted = stage(counted, "brackets")
    level = F.explode(F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: i >= F.col("_tw_i") - size))
    below = counted.where(F.col("_tw_i") >= size).select(*keys, level.alias("_tw_l"), "_tw_n", "_tw_total")
    below = below.groupBy(*keys, F.col("_tw_l").alias("_tw_i")).agg(F.sum("_tw_n").alias("_tw_n"), F.max("_tw_total").alias("_tw_total"))
    none = F.lit(None).cast(df.schema[value].dataType)
    return counted.where(F.col("_tw_i") < size).unionByName(below.withColumn("_tw_v", none))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: Mapping[str, float], few_groups: bool | None = None
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group, for groups of any size.

    Without keys, or with ``few_groups`` (so few that a row for each may be broadcast), a sketch brackets each
    quantile, what lies below is only counted, and only the values within are ordered. With many groups, equal values
    are counted before any ordering. The built-in percentile keeps the value counts of a group in one buffer.
    """
    levels = [float(f) for f in fractions.values()]
    few = not keys if few_groups is None else few_groups
    order = [F.col("_tw_v").asc_nulls_first()]
    sums = {"_tw_upto": F.col("_tw_n")}
    if few:
        placed = running_sums(_counts(df, keys, value, levels, True), [*keys, "_tw_i"], order, sums)
        hits = placed.withColumn("_tw_f", F.get(F.array(*(F.lit(f) for f in levels)), F.col("_tw_i")))
    else:
        counted = _counts(spread(df.select(*keys, value)), keys, value, levels, False).drop("_tw_i", "_tw_total")
        placed = running_sums(counted, keys, order, sums, {"_tw_total": F.col("_tw_n")})
        asked = F.inline(F.array(*(F.struct(F.lit(i).alias("_tw_i"), F.lit(f).alias("_tw_f")) for i, f in enumerate(levels))))
        hits = placed.select("*", asked)
    position = F.col("_tw_f") * (F.col("_tw_total") - 1)
    start, end = F.col("_tw_upto") - F.col("_tw_n"), F.col("_tw_upto")
    # from here on at most two rows per group and level
    hits = hits.where((start <= F.ceil(position)) & (end > F.floor(position)))
    ends = hits.groupBy(*keys, "_tw_i").agg(
        F.max(F.when((end > F.floor(position)) & (start <= F.floor(position)), F.col("_tw_v"))).alias("_tw_lo"),
        F.max(F.when((end > F.ceil(position)) & (start <= F.ceil(position)), F.col("_tw_v"))).alias("_tw_hi"),
        F.max(position - F.floor(position)).alias("_tw_part"),
    )
    level = F.col("_tw_lo") + (F.col("_tw_hi") - F.col("_tw_lo")) * F.col("_tw_part")
    return ends.withColumn("_tw_level", level.cast("double")).groupBy(*keys).agg(
        *(F.max(F.when(F.col("_tw_i") == i, F.col("_tw_level"))).alias(name) for i, name in enumerate(fractions))
    )


def with_halo(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], block_rows: int, before: int, after: int
) -> tuple[DataFrame, list[str]]:
    """Cut ordered groups into blocks that also hold their neighbours' edge rows.

    Returns the rows with ``_tw_own`` (false for borrowed rows) and the columns to
    partition a window by, so ``lag``/``lead`` up to ``before``/``after`` rows are
    right for every owned row without a whole group in one task.
    """
    if max(before, after) > block_rows:
        raise ValueError("a block must be at least as long as the longest look-around")
    numbered = number_rows(df, keys, order, "_tw_rn")
    block = F.floor((F.col("_tw_rn") - 1) / block_rows)
    inside = F.pmod(F.col("_tw_rn") - 1, F.lit(block_rows))
    targets = F.array_compact(
        F.array(
            block,
            F.when(inside >= block_rows - before, block + 1),
            F.when((inside < after) & (block > 0), block - 1),
        )
    )
    spread = (
        numbered.withColumn("_tw_home", block)
        .withColumn("_tw_block", F.explode(targets))
        .withColumn("_tw_own", F.col("_tw_block") == F.col("_tw_home"))
        .drop("_tw_home")
    )
    return spread, [*keys, "_tw_block"]
