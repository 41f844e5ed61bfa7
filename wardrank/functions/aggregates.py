"""Exact aggregate building blocks.

Averages are carried as two exact sums (numerator, denominator) and rounded
half-up at the end with integer division, so a rounded mean does not depend
on summation order, partitioning, or the size of the total weight (a
``decimal(38,13)`` quotient would start to double-round once the total
weight passes ~1e11, which a national total at scale can).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ratio_half_up(num, den, dp: int = 2) -> Column:
    """round_half_up(num / den, dp) as ``decimal(38, dp)``; NULL if den is 0/NULL.

    ``num`` is an exact decimal or integer, ``den`` an integer count/weight.
    """
    n, d = _c(num), _c(den)
    scale = 10 ** dp
    a_n, a_d = F.abs(n), F.abs(d)
    # floor((2|n|*10^dp + |d|) / (2|d|)), in exact integer arithmetic
    q = F.call_function("div", a_n * (2 * scale) + a_d, a_d * 2)
    unit = F.lit(Decimal(1).scaleb(-dp))
    sign = F.when((n < 0) != (d < 0), F.lit(-1)).otherwise(F.lit(1))
    return F.when(d != 0, (q.cast("decimal(38,0)") * unit * sign).cast(f"decimal(38,{dp})"))


def weighted_parts(value, weight, prefix: str = "_w") -> list[Column]:
    """Aggregate columns ``{prefix}_num = sum(value*weight)``, ``{prefix}_den = sum(weight)``.

    Only rows where both are present contribute to either sum.
    """
    v, w = _c(value), _c(weight)
    both = v.isNotNull() & w.isNotNull()
    return [
        F.sum(F.when(both, v * w)).alias(f"{prefix}_num"),
        F.sum(F.when(both, w)).cast("long").alias(f"{prefix}_den"),
    ]


def weighted_avg(prefix: str = "_w", dp: int = 2) -> Column:
    """Finish :func:`weighted_parts`: the rounded volume-weighted mean."""
    return ratio_half_up(f"{prefix}_num", f"{prefix}_den", dp)


def mean_parts(value, prefix: str = "_m") -> list[Column]:
    """Aggregate columns for an exact plain mean: ``sum(value)``, ``count(value)``."""
    v = _c(value)
    return [F.sum(v).alias(f"{prefix}_num"), F.count(v).alias(f"{prefix}_den")]


def plain_avg(prefix: str = "_m", dp: int = 2) -> Column:
    return ratio_half_up(f"{prefix}_num", f"{prefix}_den", dp)


def co_moments(x, y, prefix: str = "_c") -> list[Column]:
    """Aggregate columns of the exact sums that a correlation needs, over the
    rows where both integers (or integral decimals) are present."""
    a, b = (_c(v).cast("decimal(18,0)") for v in (x, y))
    both = a.isNotNull() & b.isNotNull()
    parts = {"n": F.lit(1), "x": a, "y": b, "xx": a * a, "yy": b * b, "xy": a * b}
    return [F.sum(F.when(both, v)).cast("decimal(38,0)").alias(f"{prefix}_{k}") for k, v in parts.items()]


def exact_corr(prefix: str = "_c") -> Column:
    """Finish :func:`co_moments`: Pearson's correlation, NULL where a variance
    is 0.  The co-moments are whole numbers, rounded to doubles once, so any
    partitioning gives the same bits."""
    n, x, y, xx, yy, xy = (F.col(f"{prefix}_{k}") for k in ("n", "x", "y", "xx", "yy", "xy"))
    both, own_x, own_y = ((n * p - q * r).cast("double") for p, q, r in ((xy, x, y), (xx, x, x), (yy, y, y)))
    return F.when((own_x > 0) & (own_y > 0), both / (F.sqrt(own_x) * F.sqrt(own_y)))


def distinct_in_domain(col, domain) -> Column:
    """Exact ``count(DISTINCT col)`` when ``col`` can only take the values in ``domain``.

    Each value sets one bit; ``bit_or`` is an ordinary partial aggregate, so the
    plan is a single map-side-combined shuffle instead of the two shuffles of a
    general distinct count.  A longer domain takes one mask per 63 values.  The
    caller must have filtered ``col`` to the domain (values outside count as
    none).
    """
    domain = list(dict.fromkeys(domain))
    total = F.lit(0).cast("long")
    for start in range(0, len(domain), 63):
        part = domain[start:start + 63]
        pos = F.array_position(F.array(*[F.lit(v) for v in part]), _c(col))
        bit = F.when(pos > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (pos - 1).cast("int")))
        total = total + F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(0)).cast("long")
    return total


def lowest(col, k: int) -> Column:
    """Aggregate: the ``k`` lowest values (structs by their fields in turn), in order.

    Spark's own bounded aggregate: a state holds at most ``k`` values and two
    states merge, so it is combined in the map tasks.  The API has it without
    a name in ``functions``; this is the only place that refers to it.
    """
    return InternalFunction.collect_top_k(_c(col), k, True)


def share_pct(part, total, dp: int = 1) -> Column:
    """``round(part * 100 / total, dp)`` half-up, exact, as double."""
    return ratio_half_up(_c(part) * 100, total, dp).cast("double")
