"""Types of text columns, sniffed in one pass.

Every value belongs to one class: missing, sentinel, boolean, whole number,
decimal, date or text.  A column's state is how often each class occurs and
how many digits its numbers need; states of parts of a table add up (sums and
maxima), so one partial aggregate over all columns decides the types, however
the table is split.  Nothing is sampled.

The classes form a lattice: whole numbers are decimals, and everything is text.
A column's type is the narrowest that holds all its values, or all but a share
of ``tolerance``; those that do not fit are its violations.  A number with
leading zeros (``010001``) is text: it names something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import SENTINELS

# What the classes look like.
WHOLE = r"^[+-]?(0|[1-9][0-9]*)$"
DECIMAL = r"^[+-]?(0|[1-9][0-9]*)[.][0-9]+$"
DATE = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"
BOOLEAN = r"^(true|false)$"
LONGEST = 38  # digits of the widest decimal
LONG = 18  # digits that a bigint surely holds


def _state(c: Column, sentinels) -> Column:
    """The mergeable state of one column."""
    value = F.when(c.isNotNull() & ~c.isin(*sentinels), c)
    whole, decimal = value.rlike(WHOLE), value.rlike(DECIMAL)
    digits = F.regexp_replace(value, "^[+-]", "")
    number = whole | decimal

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    return F.struct(
        F.count(F.lit(1)).alias("n_rows"), n(c.isNull()).alias("n_null"), n(c.isin(*sentinels)).alias("n_sentinel"),
        n(whole).alias("whole"), n(decimal).alias("decimal"), n(value.rlike(DATE)).alias("date"), n(value.rlike(BOOLEAN)).alias("boolean"),
        F.coalesce(F.max(F.when(number, F.length(F.substring_index(digits, ".", 1)))), F.lit(0)).alias("before"),
        F.coalesce(F.max(F.when(decimal, F.length(F.substring_index(digits, ".", -1)))), F.lit(0)).alias("after"))


def sniff_types(df: DataFrame, sentinels=SENTINELS, tolerance: float = 0.0) -> DataFrame:
    """A row per column of ``df`` (all text): ``column``, ``type``, ``n_rows``,
    ``n_null``, ``n_sentinel``, ``n_violations``.

    ``type`` is ``boolean``, ``bigint``, ``decimal(p,s)``, ``date`` or
    ``string``; a column without values is a ``string``.  ``tolerance`` is the
    share of a column's values that may violate its type.
    """
    states = df.agg(*(_state(F.col(f"`{c}`"), sentinels).alias(c) for c in df.columns))
    rows = states.select(F.explode(F.array(*(
        F.struct(F.lit(i).alias("at"), F.lit(c).alias("column"), F.col(f"`{c}`").alias("s")) for i, c in enumerate(df.columns)))).alias("r"))
    s = "r.s."
    values = F.col(s + "n_rows") - F.col(s + "n_null") - F.col(s + "n_sentinel")
    number = F.col(s + "whole") + F.col(s + "decimal")
    wide = F.col(s + "before") + F.col(s + "after")

    def holds(n: Column) -> Column:
        return (values > 0) & (values - n <= values * F.lit(tolerance))

    def typed(name: Column, n: Column) -> Column:
        return F.struct(name.alias("type"), n.alias("fit"))

    kind = (F.when(holds(F.col(s + "boolean")), typed(F.lit("boolean"), F.col(s + "boolean")))
            .when(holds(F.col(s + "date")), typed(F.lit("date"), F.col(s + "date")))
            .when(holds(F.col(s + "whole")) & (F.col(s + "before") <= LONG), typed(F.lit("bigint"), F.col(s + "whole")))
            .when(holds(number) & (wide <= LONGEST), typed(F.format_string("decimal(%d,%d)", wide, F.col(s + "after")), number))
            .otherwise(typed(F.lit("string"), values)))
    return rows.select("r.at", "r.column", kind.alias("k"), *(s + c for c in ("n_rows", "n_null", "n_sentinel")), values.alias("v")) \
        .select("column", "k.type", "n_rows", "n_null", "n_sentinel", (F.col("v") - F.col("k.fit")).alias("n_violations"), "at") \
        .orderBy("at").drop("at")
