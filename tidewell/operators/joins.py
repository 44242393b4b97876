"""Joins between logs, dimensions and per-key aggregates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.attach import attach
from tidewell.operators.ordered import last_known, number_rows
from tidewell.session import stage
from tidewell.sources.files import BROADCAST_LIMIT, plan_size


def with_group_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Per-key aggregates joined back on to the rows; rows with a null key get nulls."""
    per_key = (
        df.groupBy(*keys)
        .agg(*(expr.alias(name) for name, expr in stats.items()), F.count("*").alias("_tw_rows"))
    )
    # whether the groups are few is known once they are counted; then the rows stay where they lie
    per_key = stage(per_key, "groups")
    if plan_size(per_key) > BROADCAST_LIMIT:
        return attach(df, per_key, keys, weight="_tw_rows", keep_weight=False)
    side = per_key.select(*(F.col(k).alias(f"_tw_k_{k}") for k in keys), *stats)
    on = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_tw_k_{k}") for k in keys))
    return df.join(F.broadcast(side), on, "left").select(*df.columns, *stats)


def first_outcome(outcomes: DataFrame, key: str, observed: str) -> DataFrame:
    """One outcome per key, the earliest, so a re-sent outcome does not multiply rows."""
    rest = [c for c in outcomes.columns if c != key]
    lot = F.struct(F.col(observed), *(F.col(c) for c in rest if c != observed))
    return outcomes.groupBy(key).agg(F.min_by(F.struct(*rest), lot).alias("_tw")).select(key, "_tw.*")


def join_outcomes(
    events: DataFrame,
    outcomes: DataFrame,
    key: str,
    observed: str,
    how: str = "left",
    decided: str | None = None,
    horizon_days: int | None = None,
) -> DataFrame:
    """Events with their outcome. Left: a missing outcome is reward 0.

    With ``decided`` and ``horizon_days`` only outcomes within [decision, decision +
    horizon] count, and the earliest of these is taken.
    """
    if horizon_days is None:
        joined = attach(events, first_outcome(outcomes, key, observed), [key], how=how)
    else:
        joined = _next_outcome(events, outcomes, key, observed, decided, horizon_days, how)
    return joined.withColumn("reward", F.coalesce(F.col("reward"), F.lit(0)))


def _next_outcome(
    events: DataFrame, outcomes: DataFrame, key: str, observed: str, decided: str, horizon_days: int, how: str
) -> DataFrame:
    """Events with the first outcome from their decision on, if it lies within the horizon.

    Both logs are merged by key and, backwards, time, and every decision takes the outcome last seen; the order is cut in ranges,
    so a key with very many decisions and outcomes spreads over tasks and no pairs of them are made.
    """
    rest = [c for c in outcomes.columns if c != key]
    meets = F.col(key).isNotNull() & F.col(decided).isNotNull()
    event = F.struct(*(F.col(c).alias(c) for c in events.columns)).alias("_tw_event")
    outcome = F.struct(*(F.col(c).alias(c) for c in rest)).alias("_tw_outcome")
    none = F.lit(None)
    kind = outcomes.select(outcome).schema["_tw_outcome"].dataType
    event_kind = events.select(event).schema["_tw_event"].dataType
    late = outcomes.where(F.col(key).isNotNull() & F.col(observed).isNotNull())
    # at one moment the outcome counts for the decision, so backwards it comes first; of several, the one whose other columns are smallest comes last
    lot = F.struct(*(F.col(c) for c in rest if c != observed)) if len(rest) > 1 else F.struct(F.lit(0).alias("none"))
    lot_kind = late.select(lot.alias("lot")).schema["lot"].dataType
    log = events.where(meets).select(
        F.col(key).alias("_tw_key"), F.col(decided).cast("timestamp").alias("_tw_at"), F.lit(1).alias("_tw_side"), none.cast(lot_kind).alias("_tw_lot"), event, none.cast(kind).alias("_tw_outcome")
    ).unionByName(late.select(
        F.col(key).alias("_tw_key"), F.col(observed).cast("timestamp").alias("_tw_at"), F.lit(0).alias("_tw_side"), lot.alias("_tw_lot"), none.cast(event_kind).alias("_tw_event"), outcome
    ))
    order = [F.col("_tw_at").desc(), F.col("_tw_side").asc(), F.col("_tw_lot").desc_nulls_last()]
    merged = last_known(log, ["_tw_key"], order, {"_tw_next": "_tw_outcome"}).where("_tw_side = 1")
    end = F.col("_tw_at") + F.make_dt_interval(F.lit(horizon_days))
    found = F.when(F.col(f"_tw_next.{observed}").cast("timestamp") <= end, F.col("_tw_next"))
    placed = merged.select("_tw_event", found.alias("_tw_found"))
    if how == "left":
        rows = events.where(~F.coalesce(meets, F.lit(False))).select(event, none.cast(kind).alias("_tw_found"))
        placed = rows.unionByName(placed)
    else:
        placed = placed.where(F.col("_tw_found").isNotNull())
    return placed.select(*(F.col(f"_tw_event.{c}") for c in events.columns), *(F.col(f"_tw_found.{c}").alias(c) for c in rest))


def recover_context(outcomes: DataFrame, decisions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Outcomes with the context of their decision, and the outcomes of unknown events."""
    known = attach(outcomes, decisions, [key], how="inner")
    unknown = outcomes.join(decisions.select(key), key, "left_anti")
    return known, unknown


def align(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer alignment of two keyed results, ordered by key."""
    return left.join(right, list(keys), "full").orderBy(*keys)


#: Entries that a fixed dimension may have.
MOST_FIXED = 10_000


def pair_with_all(rows: DataFrame, fixed: DataFrame) -> DataFrame:
    """Every row with every entry of a fixed, hand-written dimension; a table that is none is refused."""
    if fixed.limit(MOST_FIXED + 1).count() > MOST_FIXED:
        raise ValueError(f"more than {MOST_FIXED} rows to pair every row with")
    return rows.crossJoin(F.broadcast(fixed))


def static_lookup(df: DataFrame, column: str, table: Mapping[str, float], default: float, name: str) -> DataFrame:
    """Value of a small fixed map, or the default."""
    entries = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return df.withColumn(name, F.coalesce(F.try_element_at(entries, F.col(column)), F.lit(default)))


def score_distinct(
    df: DataFrame, features: Sequence[str], score: Callable[[DataFrame], DataFrame], result: str
) -> DataFrame:
    """Score each distinct feature tuple once and hand the result to its duplicates."""
    tuples = df.groupBy(*features).agg(F.count("*").alias("_tw_rows"))
    scored = score(tuples).select(*features, result, "_tw_rows")
    # one struct as the key: fields that are null are equal inside it
    tag = F.struct(*features)
    return attach(
        df.withColumn("_tw_tuple", tag),
        scored.select(tag.alias("_tw_tuple"), result, "_tw_rows"),
        ["_tw_tuple"],
        weight="_tw_rows",
        keep_weight=False,
    ).drop("_tw_tuple")


def parents_with_children(
    parents: DataFrame, parent_key: str, children: DataFrame, child_parent: str, child_key: str, page_size: int = 1000
) -> DataFrame:
    """Each parent with the ordered list of its child keys, at most ``page_size`` per row.

    A parent with more children continues on further pages, so no list outgrows a
    task. A parent without children has one page with an empty list.
    """
    placed = number_rows(
        children.select(child_parent, child_key), [child_parent], [F.col(child_key)], "_tw_rn"
    ).withColumn("page", F.floor((F.col("_tw_rn") - 1) / page_size).cast("bigint"))
    lists = placed.groupBy(F.col(child_parent).alias(parent_key), "page").agg(
        F.sort_array(F.collect_list(child_key)).alias("children")
    )
    element = children.schema[child_key].dataType.simpleString()
    order = [*parents.columns, "page", "children"]
    # the lists are the large side: one parent may own a third of all pages
    some = attach(lists, parents, [parent_key], how="inner")
    owners = children.select(F.col(child_parent).alias(parent_key)).distinct()
    none = parents.join(owners, parent_key, "left_anti")
    return some.select(*order).unionByName(
        none.withColumns(
            {"page": F.lit(0).cast("bigint"), "children": F.array().cast(f"array<{element}>")}
        ).select(*order)
    )
