"""Exact distinct counts that add up over loads, as bitmaps.

A distinct count cannot be summed: a facility of two loads counts once.  Kept
as a bitmap per group over dense facility numbers, the count of several loads
is that of the bits set in any of them, so each load's facts are read once and
only the bitmaps (4 KB for 32,768 facilities) are read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def number_keys(keys: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """(``key``, ``n``): ``known`` and the keys new to it, numbered on without
    gaps (from 1).

    New keys are dealt by ranges and numbered within; the offsets of the ranges
    are summed over one row a range, so no task sees all keys.
    """
    spark = keys.sparkSession
    new = keys.select(key).filter(F.col(key).isNotNull()).distinct()
    start = F.lit(0).cast("long")
    if known is not None:
        new = new.join(known.select(key), key, "left_anti")
        start = F.coalesce(known.agg(F.max("n").alias("n")).scalar(), F.lit(0).cast("long"))
    path = scratch_path(spark, "keys")
    dealt = new.repartitionByRange(key).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)  # the bounds of the ranges are sampled: fix them
    dealt = spark.read.schema(dealt.schema).parquet(path)
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    fresh = dealt.withColumn("_place", place).join(ranges, "_range").select(
        key, (start + F.col("_first") + F.col("_place")).cast("long").alias("n"))
    return fresh if known is None else known.select(key, "n").unionByName(fresh)


def distinct_partials(facts: DataFrame, numbers: DataFrame, key: str, by) -> DataFrame:
    """One load's bitmaps: the columns ``by``, ``bucket``, ``bits``.  The facts
    are reduced to distinct (group, key) pairs before they meet the numbers."""
    pairs = facts.select(*by, key).distinct().join(numbers, key)
    return pairs.groupBy(*by, F.bitmap_bucket_number("n").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))


def roll_up(partials: DataFrame, by, name: str) -> DataFrame:
    """The exact distinct count of each group over all loads in ``partials``."""
    return partials.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits")) \
        .groupBy(*by).agg(F.sum(F.bitmap_count("bits")).cast("long").alias(name))
