"""Projections, filters, ordering, paging and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.files import broadcast_if_small
from tidewell.functions.columns import all_of, any_of, keyed_hash
from tidewell.operators.ordered import number_rows
from tidewell.operators.quantiles import column_quantiles


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop the named columns; names that are not there are ignored."""
    return df.drop(*names)


def preview(df: DataFrame, columns: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.select(*columns).orderBy(*order).limit(n)


def where_equals(df: DataFrame, **wanted) -> DataFrame:
    return df.where(all_of([F.col(c) == v for c, v in wanted.items()]))


def where_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def where_any(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    return df.where(any_of(conditions))


def literal_pattern(text: str) -> str:
    """Escape the wildcard characters of a LIKE pattern."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def search(df: DataFrame, **pieces: str | None) -> DataFrame:
    """Case-insensitive 'contains' per column; an absent or empty argument does not filter."""
    return df.where(
        all_of([F.col(c).ilike(f"%{literal_pattern(p)}%") for c, p in pieces.items() if p])
    )


def where_ends_with(
    df: DataFrame, column: str, ending: str | None = None, bound: str | None = None, at_most: float | None = None
) -> DataFrame:
    """Case-insensitive ends-with and an upper bound, both optional."""
    tests = []
    if ending:
        tests.append(F.col(column).ilike(f"%{literal_pattern(ending)}"))
    if at_most is not None:
        tests.append(F.col(bound) <= at_most)
    return df.where(all_of(tests))


def where_between(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Closed range with optional ends."""
    tests = []
    if low is not None:
        tests.append(F.col(column) >= low)
    if high is not None:
        tests.append(F.col(column) <= high)
    return df.where(all_of(tests))


def trim_outliers(df: DataFrame, column: str, fraction: float = 0.99, accuracy: int | None = None) -> DataFrame:
    """Keep positive values up to a quantile: exact, or approximate with an accuracy."""
    if accuracy:
        limit = df.agg(F.percentile_approx(column, fraction, accuracy).alias("_tw_limit"))
    else:
        limit = column_quantiles(df, column, {"_tw_limit": fraction})
    kept = df.where(F.col(column) > 0).crossJoin(F.broadcast(limit))
    return kept.where(F.col(column) <= F.col("_tw_limit")).drop("_tw_limit")


def lookup(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows for the requested keys, with ``found`` telling the missing ones.

    Few keys are broadcast, so only their rows are shuffled.
    """
    keys = wanted.select(key).distinct()
    marked = df.join(broadcast_if_small(keys), key, "left_semi").withColumn("_tw_found", F.lit(True))
    return (
        keys.join(marked, key, "left")
        .withColumn("found", F.coalesce(F.col("_tw_found"), F.lit(False)))
        .drop("_tw_found")
    )


def recode(df: DataFrame, column: str, condition: Column, value) -> DataFrame:
    return df.withColumn(column, F.when(condition, F.lit(value)).otherwise(F.col(column)))


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def add_total_and_label(df: DataFrame, parts: Sequence[str], total: str, label: str, above: float = 0) -> DataFrame:
    """Sum of the parts (a missing part counts 0) and a 0/1 label for sums above a limit."""
    summed = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0)))
    return df.withColumn(total, summed).withColumn(label, (F.col(total) > above).cast("int"))


def from_date(df: DataFrame, column: str, start) -> DataFrame:
    return df.where(F.col(column) >= F.lit(start))


def last_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last n rows by order, in ascending order."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(n).orderBy(*order)


def pick_one(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """One repeatable pick per group: the row with the smallest keyed hash.

    An aggregate, not a ranking window, so each task keeps one row per group.
    """
    rest = [c for c in df.columns if c != group]
    lot = F.struct(keyed_hash(F.col(key), seed=seed), F.col(key).cast("string"))
    picked = df.groupBy(group).agg(F.min_by(F.struct(*rest), lot).alias("_tw_row"))
    return picked.select(group, "_tw_row.*").select(*df.columns)


def sort_by_choice(df: DataFrame, column: str, ascending: bool, key: str) -> DataFrame:
    """Order by a column named by the user; an unknown name is refused."""
    if column not in df.columns:
        raise ValueError(f"unknown column {column!r}; choose one of {df.columns}")
    chosen = F.col(column).asc() if ascending else F.col(column).desc()
    return df.orderBy(chosen, F.col(key))


#: Rows before the end of a page that one task may keep in its heap, and rows of the range that is sorted for a deeper one.
SHALLOW, MOST_SORTED = 10_000, 100_000
#: Ranges that a pass tells apart, and passes at most: the last range may hold more rows only if their keys are equal.
PAGE_RANGES, MOST_PASSES = 64, 8


def newest(df: DataFrame, key: str, limit: int = 10, offset: int = 0) -> DataFrame:
    """The page of ``limit`` rows after the first ``offset`` by descending key.

    A deep page is found by rank: rows are counted by range of the key, only the range that holds the page is kept, counted again
    by finer ranges while it is large, and sorted at last. Keys that have no quantiles (texts) are sorted whole.
    """
    if offset + limit > SHALLOW and not isinstance(df.schema[key].dataType, (T.StringType, T.BinaryType, T.BooleanType)):
        df, offset = _page_range(df, key, limit, offset)
    return df.orderBy(F.desc(key)).offset(offset).limit(limit)


def _page_range(df: DataFrame, key: str, limit: int, offset: int) -> tuple[DataFrame, int]:
    """The rows of a range of keys that holds the page, and the offset in it."""
    marks = [i / PAGE_RANGES for i in range(1, PAGE_RANGES)]
    k = F.col(key)
    for _ in range(MOST_PASSES):
        total, bounds = df.where(k.isNotNull()).agg(F.count("*"), F.percentile_approx(key, marks, 100 * PAGE_RANGES)).first()
        if total <= MOST_SORTED or offset >= total:
            break
        bounds = sorted(set(bounds))
        # rows from a bound upwards come before those below it
        above = df.agg(*(F.count_if(k >= F.lit(b)).alias(f"n{i}") for i, b in enumerate(bounds))).first()
        before = [(above[i], b) for i, b in enumerate(bounds)]
        skip, high = max(((n, b) for n, b in before if n <= offset), default=(0, None), key=lambda x: x[0])
        reached, low = min(((n, b) for n, b in before if n >= offset + limit), default=(total, None), key=lambda x: x[0])
        inside = (k < F.lit(high) if high is not None else F.lit(True)) & (k >= F.lit(low) if low is not None else F.lit(True))
        df, offset = df.where(inside), offset - skip
        if reached - skip >= total:
            break
    return df, offset


def number_pages(df: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """Every row with its 1-based page and the page count (the last page may be short)."""
    if size <= 0:
        raise ValueError("page size must be positive")
    numbered = number_rows(df, [], order, "_tw_rn", total="_tw_n")
    return numbered.select(
        *df.columns,
        F.ceil(F.col("_tw_rn") / size).cast("bigint").alias("page"),
        F.ceil(F.col("_tw_n") / size).cast("bigint").alias("page_count"),
    )


def top_k(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(key)).limit(k)


def append_batches(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def union_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).union(right.select(key)).distinct().orderBy(key)


def same_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many values only one side has, and whether the sets are equal."""
    a = left.distinct().withColumn("_tw_l", F.lit(1))
    b = right.distinct().withColumn("_tw_r", F.lit(1))
    both = a.join(b, list(left.columns), "full")
    return both.agg(
        F.count_if(F.col("_tw_r").isNull()).alias("only_left"),
        F.count_if(F.col("_tw_l").isNull()).alias("only_right"),
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))
