"""Grouped quality metrics: aggregate the facts first, then join the dimension.

Facility- and group-level reports never join raw fact rows to the dimension.
The cleaned facts are first reduced to one row of exact partial sums per
facility (map-side partial aggregation, one shuffle of partial results), and
only that small frame meets ``hospitals``.  Consequences at scale:

* the join input shrinks by the number of measures per facility; for the
  roll-ups keyed by ``facility_id`` alone a sort-merge join (dimension too
  big to broadcast) shuffles only the dimension, as the aggregate is already
  hash-partitioned by ``facility_id`` (facility reports keyed by
  (facility_id, facility_name) re-shuffle their one-row-per-facility
  aggregate instead);
* a facility that owns a huge share of the fact rows is collapsed inside
  every map task before any shuffle, so no join or aggregate task receives
  it whole;
* group-level (state / ownership) aggregates roll the facility sums up with
  sum/min/max, all partial-aggregatable, so a state holding a third of all
  facilities is combined map-side as well.

Groups keyed below the facility (measure x ownership) are reduced to one row
per (facility, measure) first, so that a facility that owns a huge share of
the rows never meets the join raw, whatever the session's skew settings.

Precondition (as for any dimension): ``hospitals`` has one row per
``facility_id`` (see ``sources.files.unique_key_violations``); under it the
results equal the join-then-aggregate formulation row for row.
All rates are exact decimals rounded half-up, cast to double last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import (
    distinct_in_domain,
    mean_parts,
    plain_avg,
    weighted_avg,
    weighted_parts,
)
from ..sources.schema import MORTALITY_MEASURES
from .clean import clean_mortality, dimension

_SUMS = ("_w_num", "_w_den", "_m_num", "_m_den")


def facility_sums(facts: DataFrame, keys=("facility_id",), measures=MORTALITY_MEASURES) -> DataFrame:
    """Exact per-facility sums over cleaned fact rows (no join).

    Columns: keys, measures_available (bitmask distinct count over the known
    measure domain, so this is a single shuffle), _w_num/_w_den, _m_num/_m_den,
    _min/_max score, total_patients.
    """
    return facts.groupBy(*keys).agg(
        distinct_in_domain("measure_id", measures).alias("measures_available"),
        *weighted_parts("score", "denominator"),
        *mean_parts("score"),
        F.min("score").alias("_min"),
        F.max("score").alias("_max"),
        F.sum("denominator").cast("long").alias("total_patients"),
    )


def facility_parts(
    complications: DataFrame,
    hospitals: DataFrame,
    name: bool = True,
    attrs=("state",),
    measures=MORTALITY_MEASURES,
    min_measures: int | None = None,
) -> DataFrame:
    """Per-facility sums (keyed by facility_id [+ facility_name]) joined to the
    dimension attributes ``attrs``; facilities missing from the dimension drop
    out, exactly as with the inner join on raw rows."""
    keys = ("facility_id", "facility_name") if name else ("facility_id",)
    facts = clean_mortality(complications, hospitals, measures, join=False)
    sums = facility_sums(facts, keys, measures)
    if min_measures is not None:
        sums = sums.filter(F.col("measures_available") >= min_measures)
    return sums.join(dimension(hospitals).select("facility_id", *attrs), "facility_id")


def group_parts(
    complications: DataFrame,
    hospitals: DataFrame,
    by,
    fact_keys=(),
    derive: dict | None = None,
    dim_attrs=None,
    measures=MORTALITY_MEASURES,
    min_hospitals: int | None = None,
    max_hospitals: int | None = None,
    keep_orphans: bool = False,
) -> DataFrame:
    """Per-group sums with the exact distinct facility count ``num_hospitals``.

    ``keep_orphans`` keeps the facts of facilities missing from the dimension,
    in groups of their own (``_in_dim`` is NULL there), for national totals.

    ``by``: group columns.  Those listed in ``fact_keys`` come from the fact
    (e.g. measure_id), the rest from the dimension or from ``derive``
    (name -> column expression over the dimension attributes ``dim_attrs``,
    e.g. the ownership group).  ``min_hospitals`` keeps groups at or above it (HAVING);
    ``max_hospitals`` keeps those strictly below it (the excluded complement).
    """
    by = [by] if isinstance(by, str) else list(by)
    derive = derive or {}
    if dim_attrs is None:
        dim_attrs = [c for c in by if c not in fact_keys and c not in derive]
    dim = dimension(hospitals).select("facility_id", *dim_attrs)
    if keep_orphans:
        dim = dim.withColumn("_in_dim", F.lit(True))
        by = [*by, "_in_dim"]
    facts = clean_mortality(complications, hospitals, measures, join=False)
    sums = facts.groupBy("facility_id", *fact_keys).agg(
        *weighted_parts("score", "denominator"),
        *mean_parts("score"),
        F.min("score").alias("_min"),
        F.max("score").alias("_max"),
    )
    joined = sums.join(dim, "facility_id", "left" if keep_orphans else "inner")
    if derive:
        joined = joined.withColumns(derive)
    out = joined.groupBy(*by).agg(
        F.count_distinct("facility_id").alias("num_hospitals"),
        *[F.sum(c).alias(c) for c in _SUMS],
        F.min("_min").alias("_min"),
        F.max("_max").alias("_max"),
    )
    if min_hospitals is not None:
        out = out.filter(F.col("num_hospitals") >= min_hospitals)
    if max_hospitals is not None:
        out = out.filter(F.col("num_hospitals") < max_hospitals)
    return out


def weighted_rate(dp: int = 2):
    """Rounded volume-weighted mean of a ``*_parts`` frame, as double."""
    return weighted_avg("_w", dp).cast("double")


def plain_rate(dp: int = 2):
    return plain_avg("_m", dp).cast("double")


def exact_ratio_keys(num: str, den: str) -> list:
    """Sort keys of the unrounded ratio ``num / den``, ascending, NULLs (also a
    zero ``den``) last.

    A decimal quotient would be cut at six decimals.  The first key is the
    integer quotient, the second the remainder over ``den`` as double: two
    integers divided once, so equal ratios of different weights tie.
    """
    n, d = F.col(num) * 10, F.when(F.col(den) != 0, F.col(den))
    whole = F.call_function("div", n, d)
    rest = ((n - whole * d) * 1_000_000).cast("decimal(38,0)").cast("double") / d.cast("double")
    return [whole.asc_nulls_last(), rest.asc_nulls_last()]


def exact_weighted_key() -> list:
    """Sort keys of the unrounded weighted mean."""
    return exact_ratio_keys("_w_num", "_w_den")


def exact_plain_key() -> list:
    return exact_ratio_keys("_m_num", "_m_den")


def rounded_score(col: str, dp: int = 2, as_decimal: str | None = None):
    """``round(min/max score, dp)``; optionally via ``decimal(p,s)`` first."""
    c = F.col(col)
    if as_decimal:
        c = c.cast(as_decimal)
    return F.round(c, dp).cast("double")
