"""The shared cleaning step: filter measures, drop sentinels, cast, join.

Every facility/state/ownership analysis starts from :func:`clean_mortality`.
Filters sit on the raw fact columns so Catalyst pushes them into the Parquet
scan (``PushedFilters: In(measure_id, ...), Not(In(score, ...))``) and, for a
fact table partitioned by ``measure_id``, prunes whole partitions.  The join
carries no hint: Spark broadcasts the dimension only while its estimated (and,
under AQE, measured) size is below the broadcast threshold and otherwise uses
a sort-merge join.  Row-level consumers (recommendations and the
measure x ownership roll-up) join here; facility and state/ownership reports
call it with ``join=False`` and meet the dimension only after aggregating
(see ``operators.metrics``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casts import count_value, reported, rounded_score, score_value
from ..sources.schema import MIN_PATIENTS, MORTALITY_MEASURES

DIMENSION_COLUMNS = ("facility_id", "state", "city", "hospital_type", "ownership")


def dimension(hospitals: DataFrame) -> DataFrame:
    """The dimension attributes the analyses read (facility name comes from the fact)."""
    return hospitals.select(*DIMENSION_COLUMNS)


def clean_mortality(
    complications: DataFrame,
    hospitals: DataFrame,
    measures=MORTALITY_MEASURES,
    join: bool = True,
) -> DataFrame:
    """Typed mortality rows: one per (facility, measure) with a usable score.

    Columns: facility_id, facility_name, measure_id, measure_name, compared,
    score decimal(18,6), denominator bigint, and (``join=True``) the dimension
    attributes state, city, hospital_type, ownership.  Rows whose score or
    denominator is a sentinel, NULL or not a number are dropped.
    ``join=False`` keeps facilities missing from the dimension (national
    figures are computed that way).
    """
    facts = (
        complications.filter(F.col("measure_id").isin(*measures))
        .filter(reported("score") & reported("denominator"))
        .select(
            "facility_id", "facility_name", "measure_id", "measure_name", "compared",
            score_value("score").alias("score"),
            count_value("denominator").alias("denominator"),
        )
        .filter(F.col("score").isNotNull() & F.col("denominator").isNotNull())
    )
    if not join:
        return facts
    return facts.join(dimension(hospitals), "facility_id")


def rejected_rows(complications: DataFrame, measures=MORTALITY_MEASURES) -> DataFrame:
    """Per measure: reported rows that :func:`clean_mortality` drops because a
    value does not parse (sentinels and NULLs are not reported values), and
    scores that are kept rounded."""
    bad_score = reported("score") & score_value("score").isNull()
    bad_count = reported("denominator") & count_value("denominator").isNull()
    return (
        complications.filter(F.col("measure_id").isin(*measures))
        .groupBy("measure_id")
        .agg(F.count(F.lit(1)).alias("total_rows"),
             F.count(F.when(bad_score, 1)).alias("rejected_scores"),
             F.count(F.when(bad_count, 1)).alias("rejected_denominators"),
             F.count(F.when(rounded_score("score"), 1)).alias("rounded_scores"))
        .orderBy("measure_id")
    )


def eligible_rows(
    complications: DataFrame,
    hospitals: DataFrame,
    measures=MORTALITY_MEASURES,
    min_patients: int = MIN_PATIENTS,
    state: str | None = None,
    measure: str | None = None,
) -> DataFrame:
    """Recommendation cohort: clean rows with at least ``min_patients`` patients.

    ``state`` / ``measure`` narrow to one slice; both are plain column
    comparisons (bound values, no SQL text), pushed to the scans.
    """
    ms = measures if measure is None else (measure,)
    rows = clean_mortality(complications, hospitals, ms)
    if state is not None:
        rows = rows.filter(F.col("state") == state)
    return rows.filter(F.col("denominator") >= min_patients)
