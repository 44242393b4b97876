"""Changing a keyed table by a batch of inserts, updates and deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.attach import attach
from tidewell.operators.ordered import number_rows
from tidewell.operators.sift import key_filter, worth_sifting


def append_with_ids(base: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Append rows without a key; keys continue after the largest one in use."""
    top = base.agg(F.coalesce(F.max(key), F.lit(-1)).alias("_tw_top"))
    numbered = number_rows(new, [], [F.col(c) for c in order], "_tw_rn").crossJoin(F.broadcast(top))
    added = numbered.withColumn(
        key, (F.col("_tw_top") + F.col("_tw_rn")).cast(base.schema[key].dataType)
    ).select(*base.columns)
    return base.unionByName(added)


def replace_ids(df: DataFrame, order: Sequence[Column], name: str = "id") -> DataFrame:
    """0-based running id over a stated order."""
    return number_rows(df, [], order, "_tw_rn").withColumn(name, F.col("_tw_rn") - 1).drop("_tw_rn")


def latest_fields(changes: DataFrame, key: str, seq: str, fields: Sequence[str]) -> DataFrame:
    """Per key and field the value of the last change that set the field.

    A null field of a change means 'not given'. Aggregates, so a key that is
    changed very often still shrinks to one row per task before the shuffle.
    """
    return changes.groupBy(key).agg(
        *(F.max_by(f, F.when(F.col(f).isNotNull(), F.col(seq))).alias(f"_tw_new_{f}") for f in fields)
    )


def touched(base: DataFrame, changes: DataFrame, key: str, bits: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``base`` that the changes may touch, and the rest, which need not be shuffled; all rows and None where sifting is not worth it.

    A Bloom filter over the changed keys goes to two scans of the base, one for each part. ``bits`` fixes its size and asks for it in any case.
    """
    if bits is None and not worth_sifting(base, changes):
        return base, None
    sieve = key_filter(changes.select(key), key, bits)
    return (base, None) if sieve is None else sieve.split(base, key)


def _with_rest(changed: DataFrame, rest: DataFrame | None) -> DataFrame:
    return changed if rest is None else changed.unionByName(rest)


def apply_updates(
    base: DataFrame, changes: DataFrame, key: str, seq: str, fields: Sequence[str], bits: int | None = None
) -> DataFrame:
    """Partial update: only fields present in the changes overwrite."""
    base, rest = touched(base, changes, key, bits)
    return _with_rest(_updated(base, changes, key, seq, fields), rest)


def _updated(base: DataFrame, changes: DataFrame, key: str, seq: str, fields: Sequence[str]) -> DataFrame:
    joined = base.join(latest_fields(changes, key, seq, fields), key, "left")
    return joined.select(
        *(
            F.coalesce(F.col(f"_tw_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
            for c in base.columns
        )
    )


def apply_deletes(base: DataFrame, keys: DataFrame, key: str, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The remaining rows, and the requested keys that are not in the table."""
    wanted = keys.select(key).distinct()
    base, rest = touched(base, keys, key, bits)
    return _with_rest(base.join(wanted, key, "left_anti").select(*base.columns), rest), wanted.join(base.select(key), key, "left_anti")


def fold_changes(changes: DataFrame, key: str, seq: str, op: str, fields: Sequence[str]) -> DataFrame:
    """Reduce an ordered log of insert/update/delete to one row per key.

    The row holds the last delete, the first insert after it, and per field the last
    given value with its position. Three aggregates: no key is ever replayed in a task.
    """
    deleted = changes.where(F.col(op) == "delete").groupBy(key).agg(F.max(seq).alias("_tw_deleted"))
    inserts = attach(changes.where(F.col(op) == "insert").select(key, seq), deleted, [key])
    after_delete = F.col("_tw_deleted").isNull() | (F.col(seq) > F.col("_tw_deleted"))
    started = inserts.where(after_delete).groupBy(key).agg(F.min(seq).alias("_tw_started"))
    given = changes.where(F.col(op) != "delete").groupBy(key).agg(
        *(
            F.max(F.when(F.col(f).isNotNull(), F.struct(F.col(seq).alias("at"), F.col(f).alias("value"))))
            .alias(f"_tw_new_{f}")
            for f in fields
        )
    )
    return given.join(deleted, key, "full").join(started, key, "full")


def apply_changes(base: DataFrame, changes: DataFrame, key: str, seq: str, op: str, bits: int | None = None) -> DataFrame:
    """The table after the whole ordered change log; the last change of a field wins.

    A null field of a change means 'not given'. An update of a key that does not exist
    at that point has no effect; an insert of an existing key acts as an update. Rows that no change
    can touch meet neither the changes nor a shuffle, see ``touched``.
    """
    base, rest = touched(base, changes, key, bits)
    return _with_rest(_changed(base, changes, key, seq, op), rest)


def _changed(base: DataFrame, changes: DataFrame, key: str, seq: str, op: str) -> DataFrame:
    fields = [c for c in base.columns if c != key]
    folded = fold_changes(changes, key, seq, op, fields)
    joined = base.withColumn("_tw_old", F.lit(True)).join(folded, key, "full")
    never_left = F.col("_tw_old").isNotNull() & F.col("_tw_deleted").isNull()
    counts = {f: never_left | (F.col(f"_tw_new_{f}.at") >= F.col("_tw_started")) for f in fields}
    return joined.where(never_left | F.col("_tw_started").isNotNull()).select(
        *(
            F.col(c)
            if c == key
            else F.coalesce(
                F.when(counts[c], F.col(f"_tw_new_{c}.value")), F.when(never_left, F.col(c))
            ).alias(c)
            for c in base.columns
        )
    )


def guard_unique(
    base: DataFrame, new: DataFrame, key: str, seq: str, bits: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """New rows with a free key, and the refused rows with the reason.

    Of several new rows with one key the first by ``seq`` is accepted. Only keys of the table that may be among the new ones are shuffled.
    """
    base, _ = touched(base.select(key), new, key, bits)
    firsts = new.groupBy(key).agg(F.min(seq).alias("_tw_first"), F.count("*").alias("_tw_n"))
    taken = base.select(key).distinct().withColumn("_tw_taken", F.lit(True))
    marks = firsts.join(taken, key, "left")
    judged = attach(new, marks, [key], weight="_tw_n").withColumn(
        "reason",
        F.when(F.col("_tw_taken"), F.lit("key taken")).when(
            F.col(seq) != F.col("_tw_first"), F.lit("repeated in batch")
        ),
    )
    accepted = judged.where(F.col("reason").isNull()).select(*new.columns)
    refused = judged.where(F.col("reason").isNotNull()).select(*new.columns, "reason")
    return accepted, refused
