"""Sentinel-safe typed views of the raw string columns.

Raw ``score`` / ``denominator`` hold a number or a sentinel string
(``Not Available`` / ``Not Applicable``).  A plain CAST of a sentinel fails
under ANSI mode, so every cast here is a ``try_cast`` (NULL on failure).  The
score is an exact ``decimal(18,6)`` and the patient count a bigint: products
and their sums are exact ``decimal(38,6)`` values, which keeps rounded
averages identical on any engine.  A reported value that does not parse, or is
rounded to six decimals, is counted by ``operators.clean.rejected_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import SCORE_TYPE, SENTINELS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def score_value(col="score") -> Column:
    """String score -> decimal(18,6); sentinels and junk -> NULL."""
    return _c(col).try_cast(SCORE_TYPE)


def count_value(col="denominator") -> Column:
    """String patient count -> bigint; sentinels, junk, '1,234' -> NULL.

    An integral decimal ('300.0') is a count; '300.5' and '300.0000001' are
    not: the digits are looked at before any rounding.
    """
    c = _c(col)
    wide = c.try_cast("decimal(38,6)")
    return F.when((wide == F.floor(wide)) & ~c.rlike(r"[.][0-9]*[1-9]"), wide.try_cast("bigint"))


def rounded_score(col="score") -> Column:
    """Whether :func:`score_value` rounds: there are digits past the sixth
    decimal."""
    return score_value(col).isNotNull() & _c(col).rlike(r"[.][0-9]{6}[0-9]*[1-9]")


def reported(col) -> Column:
    """``col NOT IN (sentinels)``; NULL stays NULL, so a filter drops it."""
    return ~_c(col).isin(*SENTINELS)
