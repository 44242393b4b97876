"""A Bloom filter over few keys, put to the scan of a large table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.sources.files import plan_size

#: Bits for each key, probes of a key, and the largest filter (2 MB). More keys than fit are no few keys any more.
BITS_PER_KEY, PROBES, MAX_BITS = 16, 4, 1 << 24
#: A table is sifted when the statistics give it so many times the size of the changes.
WORTH = 8


@dataclass(frozen=True)
class KeyFilter:
    """One row with the bits, to be broadcast: at most ``MAX_BITS``."""

    bits: DataFrame
    size: int

    def _hit(self, key: str) -> Column:
        def probe(at: Column) -> Column:
            word = F.get("_tw_bits", F.shiftrightunsigned(at, 6).cast("int"))
            return F.call_function("shiftrightunsigned", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1

        return reduce(lambda a, b: a & b, (probe(p) for p in _places(F.col(key), self.size)))

    def split(self, df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """Rows whose key may be among the keys, and those whose key surely is not (null ones among them)."""
        both = df.crossJoin(F.broadcast(self.bits))
        hit = F.col(key).isNotNull() & self._hit(key)
        return both.where(hit).select(*df.columns), both.where(~hit).select(*df.columns)


def _places(key: Column, size: int) -> list[Column]:
    """Bits of a key; ``size`` is a power of two."""
    mask = F.lit(size - 1).cast("bigint")
    return [F.xxhash64(key, F.lit(i)).bitwiseAND(mask) for i in range(PROBES)]


def key_filter(keys: DataFrame, key: str, size: int | None = None) -> KeyFilter | None:
    """The filter of the keys, of ``size`` bits (a power of two of 64 or more) or as many as they need; None if they need too many."""
    spark = keys.sparkSession
    if size is None:
        n = keys.agg(F.approx_count_distinct(key)).first()[0]
        size = max(1024, 1 << (max(1, n * BITS_PER_KEY) - 1).bit_length())
        if size > MAX_BITS:
            return None
    places = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), size))).alias("at"))
    words = places.groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")
    )
    dense = np.zeros(size // 64, np.int64)
    for r in words.collect():  # at most size / 64 rows
        dense[r["word"]] = r["bits"]
    return KeyFilter(spark.createDataFrame([(dense.tolist(),)], "_tw_bits array<bigint>"), size)


def worth_sifting(base: DataFrame, changes: DataFrame) -> bool:
    return plan_size(base) >= WORTH * plan_size(changes)
