"""Joining one row per key on to a large table whose keys may be skewed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows (one part in so many) and this many rows.
HOT_SHARE, HOT_ROWS = 1000, 1000
#: Keys that the frequency sketch of a task follows.
TRACKED_KEYS = 16_384


def _lacks(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))


def hot_keys(big: DataFrame, keys: Sequence[str]) -> list[int]:
    """Hashes of the keys that hold many rows of ``big``, at most HOT_SHARE of them.

    One pass over the key columns with a frequency sketch per task; no rows are shuffled.
    """
    hashed = big.where(~_lacks(keys)).select(F.xxhash64(*keys).alias("_tw_h"))
    row = hashed.agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(_tw_h, {HOT_SHARE}, {TRACKED_KEYS})").alias("top")
    ).first()
    least = max(HOT_ROWS, row["n"] // HOT_SHARE)
    return sorted(t["item"] for t in row["top"] or [] if t["count"] >= least)


def attach(
    big: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    weight: str | None = None,
    how: str = "left",
    keep_weight: bool = True,
) -> DataFrame:
    """Join ``per_key`` (unique on ``keys``) on to ``big``; null keys never match.

    Without a hot key this is one shuffle join. The rows of hot keys are answered where they lie, from a
    broadcast of the at most HOT_SHARE rows of ``per_key`` with such a key, and also when they have no partner
    there; then they travel with a null key and a salt, so they spread instead of meeting in one task. ``weight``
    names a column of ``per_key`` that the result can do without (``keep_weight``).
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    values = [c for c in per_key.columns if c not in keys]
    kept = [v for v in values if keep_weight or v != weight]
    # said once up front, so both uses of per_key stay the same plan and share its shuffle
    per_key = per_key.where(~_lacks(keys))
    hot = hot_keys(big, keys)
    packed = F.struct(*(F.col(v).alias(v) for v in kept), F.lit(True).alias("_tw_hit"))

    if not hot:
        side = per_key.select(*(F.col(k).alias(f"_tw_k_{k}") for k in keys), packed.alias("_tw_found"))
        on = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_tw_k_{k}") for k in keys))
        joined = big.join(side, on, how)
        return joined.select(*big.columns, *(F.col("_tw_found")[v].alias(v) for v in kept))

    is_hot = F.xxhash64(*keys).isin(hot)
    hot_side = per_key.where(is_hot).select(*(F.col(k).alias(f"_tw_h_{k}") for k in keys), packed.alias("_tw_hot"))
    on_hot = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_tw_h_{k}") for k in keys))
    apart = is_hot | _lacks(keys)
    probe = (
        big.join(F.broadcast(hot_side), on_hot, "left")
        .withColumns({f"_tw_c_{k}": F.when(~apart, F.col(k)) for k in keys})
        .withColumn("_tw_salt", F.when(apart, F.spark_partition_id() + 1).otherwise(F.lit(0)).cast("bigint"))
    )
    # always 0, but computed from the key, so the salt remains a join key
    zero = F.xxhash64(*keys).bitwiseAND(F.lit(0).cast("bigint"))
    cold = per_key.where(~is_hot).select(*(F.col(k).alias(f"_tw_k_{k}") for k in keys), zero.alias("_tw_zero"), packed.alias("_tw_cold"))
    on_cold = reduce(
        lambda a, b: a & b,
        [F.col("_tw_salt") == F.col("_tw_zero")] + [F.col(f"_tw_c_{k}") == F.col(f"_tw_k_{k}") for k in keys],
    )
    joined = probe.join(cold, on_cold, "left")
    found = F.coalesce(F.col("_tw_hot"), F.col("_tw_cold"))
    if how == "inner":
        joined = joined.where(found.isNotNull())
    return joined.select(*big.columns, *(found[v].alias(v) for v in kept))
