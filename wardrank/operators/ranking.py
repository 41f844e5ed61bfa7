"""Ranking and top-k.

* A top-k is cut by ``row_number() <= k`` in (order, tiebreak) first, or, over
  the whole frame, by an ordered limit; the tie-sharing rank is taken over the
  k rows that are left, where it is the same.  Catalyst plans the cut twice, in
  every map task before the shuffle and once after it, so at most k rows a task
  and slice are moved, however many rows of a hot slice tie.
* ``LIMIT k`` after ``ORDER BY rank`` is non-deterministic under ties; the
  ``tiebreak`` columns give it a total order (rank, tiebreak...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def _cols(cols) -> list[Column]:
    if cols is None:
        return []
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _order(cols) -> list[Column]:
    """Sort keys; a bare name sorts ascending with NULLs last (a NULL rate
    never takes rank 1)."""
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in cols]


def _window(order, partition_by=None):
    w = Window.partitionBy(*_cols(partition_by)) if partition_by else Window
    return w.orderBy(*_order(order))


def with_rank(df: DataFrame, order, name: str, partition_by=None) -> DataFrame:
    """``RANK() OVER ([PARTITION BY ...] ORDER BY order)`` as bigint.

    Without ``partition_by`` all rows meet in one task; use it on grouped
    frames with few rows (states, ownership types), or via :func:`top_k`.
    """
    return df.withColumn(name, F.rank().over(_window(order, partition_by)).cast("long"))


def top_k(df: DataFrame, k: int, order, name: str, tiebreak, partition_by=None) -> DataFrame:
    """The first ``k`` rows in (order, tiebreak) order, per partition, with
    their rank by ``order`` alone: the deterministic form of
    ``ORDER BY rank LIMIT k``."""
    total = _order(order) + _order(tiebreak)
    if partition_by is None:
        first = df.orderBy(*total).limit(k)
    else:
        cut = "_cut"
        first = (
            df.withColumn(cut, F.row_number().over(_window(total, partition_by)))
            .filter(F.col(cut) <= k)
            .drop(cut)
        )
    return with_rank(first, order, name, partition_by)


def edges(df: DataFrame, k: int, value: str) -> tuple[Column, Column]:
    """The values that the ranks 1 to ``k`` reach, from below and from above.

    Both come from one histogram of the distinct values: its k lowest and its
    k highest values suffice, with running counts from either end.  NULL values
    have no rank.
    """
    v = F.col(value)
    hist = df.filter(v.isNotNull()).groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))

    def end(order: Column, pick, name: str) -> DataFrame:
        """At most k rows: a value counts if fewer than k rows come before it."""
        before = F.sum("_n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        near = hist.orderBy(order).limit(k).withColumn("_before", F.coalesce(before, F.lit(0)))
        return near.agg(pick(F.when(F.col("_before") < k, F.col("_v"))).alias(name))

    return end(F.asc("_v"), F.max, "low").scalar(), end(F.desc("_v"), F.min, "high").scalar()


def within_rank(df: DataFrame, k: int, value: str, descending: bool = False) -> DataFrame:
    """Rows whose rank by ``value`` is at most ``k``, all ties kept, filtered
    where they are."""
    low, high = edges(df, k, value)
    return df.filter(F.col(value) >= high if descending else F.col(value) <= low)


def histogram_rank(df: DataFrame, value: str, name: str, descending: bool = False) -> DataFrame:
    """``RANK() OVER (ORDER BY value)`` over a whole frame without one task.

    Count rows per distinct value (partial aggregation), store that histogram
    dealt by ranges of the value, take a running sum within every range and
    add the rows of the ranges before it (the only single-partition window,
    over one row a range), and join the rank back.  rank(v) =
    1 + rows strictly before v; NULLs sort last.  No hint is given: the
    measured size of the histogram decides the join.

    ``df`` is read twice (histogram and join): pass a stored frame.
    """
    v = F.col(value)
    hist = df.groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    order = F.col("_v").desc_nulls_last() if descending else F.col("_v").asc_nulls_last()
    path = scratch_path(df.sparkSession, "histogram")
    dealt = hist.repartitionByRange(order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)  # the bounds of the ranges are sampled: fix them
    dealt = df.sparkSession.read.schema(dealt.schema).parquet(path)

    def before(window):
        return F.coalesce(F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    ranges = dealt.groupBy("_range").agg(F.sum("_n").alias("_n"))
    ranges = ranges.select("_range", before(Window.orderBy("_range")).alias("_first"))
    ranks = (dealt.select("_v", "_range", before(Window.partitionBy("_range").orderBy(order)).alias("_before"))
             .join(F.broadcast(ranges), "_range")
             .select("_v", (F.col("_first") + F.col("_before") + 1).cast("long").alias(name)))
    return df.join(ranks, v.eqNullSafe(F.col("_v"))).drop("_v")
