"""Run-time reduction of a fact table to the keys of a slice.

A slice on a dimension attribute (one state) fixes which facilities count, but
a join after the aggregate comes too late: the whole nation has been
aggregated and shuffled by then.  :func:`near_keys` builds a Bloom filter of
the slice's keys with plain aggregates and tests every fact row against it
where it is scanned, before anything is shuffled.  What passes holds all rows
of the slice and a few others; the join that follows is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = 64


def _places(key: Column, bits: int, hashes: int) -> list[Column]:
    """Bits of a key, by double hashing."""
    low = F.lit((1 << 40) - 1)
    a, b = F.xxhash64(key).bitwiseAND(low), F.xxhash64(F.lit(1), key).bitwiseAND(low)
    return [(a + b * i).bitwiseAND(F.lit(bits - 1)) for i in range(hashes)]


def key_filter(keys: DataFrame, key: str, bits: int = 1 << 20, hashes: int = 3) -> Column:
    """The Bloom filter of the column ``key`` of ``keys``, as a scalar array of
    64-bit words.

    Its size is ``bits`` (a power of two; 128 KiB by default) whatever the
    number of keys; more keys only let more other rows pass: of keys that are
    not in it a share of ``(1 - exp(-hashes * n / bits)) ** hashes``.
    """
    place = F.explode(F.array(*_places(F.col(key), bits, hashes)))
    set_bits = keys.filter(F.col(key).isNotNull()).select(place.alias("_p")).select(
        F.shiftrightunsigned("_p", 6).alias("_w"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_p").bitwiseAND(F.lit(_WORD - 1)).cast("int")).alias("_b"))
    every = keys.sparkSession.range(bits // _WORD).select(F.col("id").alias("_w"), F.lit(0).cast("long").alias("_b"))
    words = set_bits.unionByName(every).groupBy("_w").agg(F.bit_or("_b").alias("_b"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("_w", "_b"))), lambda s: s["_b"]).alias("words")).scalar()


def near_keys(df: DataFrame, key: str, keys: DataFrame, bits: int = 1 << 20, hashes: int = 3) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among ``keys``; no row whose key
    is among them is lost.  NULL keys go, as in a join."""
    words = key_filter(keys, key, bits, hashes)
    held = F.col(key).isNotNull()
    for p in _places(F.col(key), bits, hashes):
        word = F.get(words, F.shiftrightunsigned(p, 6).cast("int"))
        held &= F.call_function("bit_get", word, p.bitwiseAND(F.lit(_WORD - 1)).cast("int")) == 1
    return df.filter(held)
