"""Categorical recodes and display labels, all native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import MEASURE_LABELS, OWNERSHIP_DEFAULT, OWNERSHIP_RULES


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ownership_group(col="ownership", strict: bool = False) -> Column:
    """VA / Non-profit / For-profit / Government, first match wins.

    The default arm also absorbs Physician, Tribal and NULL ownership (as the
    analysis it mirrors does); ``strict=True`` labels those ``Other`` instead.
    LIKE is case-sensitive on purpose.
    """
    c = _c(col)
    expr = None
    for kind, pattern, label in OWNERSHIP_RULES:
        cond = c.like(pattern) if kind == "like" else c == pattern
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    if strict:
        expr = expr.when(c.startswith("Government"), OWNERSHIP_DEFAULT)
        return expr.otherwise("Other")
    return expr.otherwise(OWNERSHIP_DEFAULT)


def measure_label(col="measure_id") -> Column:
    """Short chart label for a measure code (literal map; NULL if unknown)."""
    pairs = []
    for k, v in MEASURE_LABELS.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)[_c(col)]


def hospital_label(name="facility_name", state="state") -> Column:
    """``Name (ST)``; NULL if either part is NULL, like SQL ``||``."""
    return F.concat(_c(name), F.lit(" ("), _c(state), F.lit(")"))


def fixed1(col) -> Column:
    """One-decimal text of an exact decimal, rounded half-up (``12.25`` -> ``12.3``)."""
    return F.round(_c(col), 1).cast("decimal(38,1)").cast("string")
