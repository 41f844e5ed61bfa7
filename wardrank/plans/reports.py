"""Facility, state, ownership and condition reports.

Each function takes the two canonical tables (``complications`` fact,
``hospitals`` dimension) plus parameters, and returns a lazy DataFrame with
final column names and types (counts/ranks bigint, rates double, text string).
Nothing is collected; one action runs the whole plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import co_moments, exact_corr, ratio_half_up, share_pct, weighted_avg, weighted_parts
from ..functions.casts import reported, score_value
from ..functions.labels import hospital_label, measure_label, ownership_group
from ..operators.clean import clean_mortality, dimension
from ..operators.distinct import distinct_partials, number_keys, roll_up
from ..operators.metrics import (
    exact_plain_key,
    exact_weighted_key,
    facility_parts,
    group_parts,
    plain_rate,
    rounded_score,
    weighted_rate,
)
from ..operators.ranking import edges, histogram_rank, top_k, with_rank
from ..session import scratch_path
from ..sources.schema import (
    MIN_MEASURES,
    MIN_OWNER_HOSPITALS,
    MIN_STATE_CHART,
    MIN_STATE_HOSPITALS,
    MORTALITY_MEASURES,
    OWNERSHIP_GROUPS,
    TOP_FACILITIES,
    TOP_STATES,
    VETERANS_PATTERN,
    VOLUME_BAND_EDGE,
    WORSE,
)


# --------------------------------------------------------------- catalog ---
def measure_catalog(complications: DataFrame, hospitals: DataFrame | None = None) -> DataFrame:
    """Distinct facilities per measure, most first (no dimension join)."""
    return (
        complications.groupBy("measure_id", "measure_name")
        .agg(F.count_distinct("facility_id").alias("num_hospitals"))
        .orderBy(F.desc("num_hospitals"), "measure_id", "measure_name")
    )


def measure_catalog_of_loads(loads: list[DataFrame]) -> DataFrame:
    """:func:`measure_catalog` over several loads of facts, each read once: its
    facilities are numbered on, its bitmaps stored; the counts are rolled up
    from the stored bitmaps."""
    by, numbers, partials = ["measure_id", "measure_name"], None, None
    for facts in loads:
        numbers = _stored(number_keys(facts, "facility_id", numbers), "numbers")
        part = _stored(distinct_partials(facts, numbers, "facility_id", by), "bitmaps")
        partials = part if partials is None else partials.unionByName(part)
    return roll_up(partials, by, "num_hospitals").select("measure_id", "measure_name", "num_hospitals") \
        .orderBy(F.desc("num_hospitals"), "measure_id", "measure_name")


def measure_distribution(complications: DataFrame, hospitals: DataFrame | None = None,
                         measure: str = "MORT_30_AMI") -> DataFrame:
    """Rows per national-comparison class for one measure, with share in % (1 dp).

    The share's total is a window over the grouped frame, i.e. over one row
    per class, not over the fact rows.
    """
    counts = (
        complications.filter((F.col("measure_id") == measure) & F.col("compared").isNotNull())
        .groupBy("compared")
        .agg(F.count(F.lit(1)).alias("num_hospitals"))
    )
    total = F.sum("num_hospitals").over(Window.partitionBy())
    return counts.select(
        "compared", "num_hospitals", share_pct(F.col("num_hospitals"), total, 1).alias("pct")
    ).orderBy(F.desc("num_hospitals"), "compared")


def outliers(complications: DataFrame, hospitals: DataFrame, measure: str = "MORT_30_AMI",
             compared: str = WORSE) -> DataFrame:
    """Facilities in one comparison class for one measure, worst score first."""
    return (
        complications.filter((F.col("measure_id") == measure) & (F.col("compared") == compared))
        .join(dimension(hospitals), "facility_id")
        .select("facility_id", "facility_name", "state", "hospital_type", "score", "denominator")
        .orderBy(score_value("score").desc_nulls_last(), "facility_id")
    )


# ------------------------------------------------------------- facilities ---
def _facility_scores(complications, hospitals, attrs, min_measures, name=True):
    return facility_parts(complications, hospitals, name=name, attrs=attrs,
                          min_measures=min_measures)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def composite_weighted(complications: DataFrame, hospitals: DataFrame, k: int = TOP_FACILITIES,
                       min_measures: int = MIN_MEASURES) -> DataFrame:
    """Top-k facilities by volume-weighted mortality over the five measures.

    Ranked on the value rounded to 2 dp (ties share a rank); exactly k rows,
    ties at the cut broken by facility_id.
    """
    scores = _facility_scores(complications, hospitals, ("state",), min_measures)
    flat = scores.select(
        "facility_id", "facility_name", "state", "measures_available",
        weighted_rate().alias("weighted_avg_mortality"),
        rounded_score("_min").alias("best_measure"),
        rounded_score("_max").alias("worst_measure"),
        "total_patients",
    )
    return top_k(flat, k, "weighted_avg_mortality", "quality_rank", tiebreak="facility_id")


def composite_ranked(complications: DataFrame, hospitals: DataFrame,
                     min_measures: int = MIN_MEASURES) -> DataFrame:
    """Every eligible facility with its national rank (the full ranking the
    top-k is cut from).  Ranked by :func:`histogram_rank` on the 2-dp rate,
    so no task ever holds all facilities.  The facility scores, one row each,
    are stored once in the shared scratch folder, so the facts are read once."""
    scores = _facility_scores(complications, hospitals, ("state",), min_measures)
    flat = scores.select(
        "facility_id", "facility_name", "state", "measures_available",
        weighted_rate().alias("weighted_avg_mortality"),
        rounded_score("_min").alias("best_measure"),
        rounded_score("_max").alias("worst_measure"),
        "total_patients",
    )
    return histogram_rank(_stored(flat, "facility-scores"), "weighted_avg_mortality", "quality_rank") \
        .orderBy("quality_rank", "facility_id")


def composite_simple(complications: DataFrame, hospitals: DataFrame, k: int = TOP_FACILITIES,
                     min_measures: int = MIN_MEASURES) -> DataFrame:
    """As :func:`composite_weighted` with a plain mean, grouped by facility
    only; State is fetched by joining the facility aggregate to the dimension
    (the aggregate-then-join shape every facility report uses)."""
    scores = _facility_scores(complications, hospitals, ("state",), min_measures)
    flat = scores.select(
        "facility_id", "facility_name", "measures_available",
        plain_rate().alias("avg_mortality_rate"),
        rounded_score("_min").alias("best_measure"),
        rounded_score("_max").alias("worst_measure"),
        "total_patients", "state",
    )
    return top_k(flat, k, "avg_mortality_rate", "quality_rank", tiebreak="facility_id")


def best_worst(complications: DataFrame, hospitals: DataFrame, k: int = TOP_FACILITIES,
               min_measures: int = MIN_MEASURES) -> DataFrame:
    """Best and worst k facilities (ties kept) as ``Name (ST)`` rows, tagged.

    The finished facility scores, two columns a facility, are stored once in
    the shared scratch folder.  Both edges come from one histogram of them, and
    one pass puts every row into the lists it belongs to (bag semantics: a
    facility in both lists appears twice).
    """
    scores = _facility_scores(complications, hospitals, ("state",), min_measures)
    flat = _stored(scores.select(
        hospital_label().alias("hospital"),
        weighted_rate().alias("weighted_avg_mortality"),
    ), "facility-rates")
    low, high = edges(flat, k, "weighted_avg_mortality")
    rate = F.col("weighted_avg_mortality")
    lists = F.array_compact(F.array(F.when(rate <= low, F.lit(f"Top {k}")), F.when(rate >= high, F.lit(f"Bottom {k}"))))
    return (
        flat.filter((rate <= low) | (rate >= high))
        .select("hospital", "weighted_avg_mortality", F.explode(lists).alias("category"))
        .orderBy("weighted_avg_mortality", "category", "hospital")
    )


def volume_vs_quality(complications: DataFrame, hospitals: DataFrame,
                      min_measures: int = MIN_MEASURES) -> DataFrame:
    """Per facility: ownership group, weighted mortality, volume, measure count."""
    scores = _facility_scores(complications, hospitals, ("ownership",), min_measures)
    return scores.select(
        "facility_name",
        ownership_group("ownership").alias("ownership_group"),
        weighted_rate().alias("weighted_avg_mortality"),
        "total_patients",
        "measures_available",
    )


def volume_band_quality(complications: DataFrame, hospitals: DataFrame,
                        edge: int = VOLUME_BAND_EDGE,
                        min_measures: int = MIN_MEASURES) -> DataFrame:
    """Facilities per volume band (total patients below / at-or-above ``edge``):
    count, mean of facility weighted mortality (2 dp) and the correlation of
    volume and mortality, from exact sums (:func:`exact_corr`)."""
    scores = _facility_scores(complications, hospitals, (), min_measures, name=False)
    fac = scores.select(
        F.when(F.col("total_patients") < edge, "small").otherwise("large").alias("volume_band"),
        "total_patients",
        weighted_avg("_w").alias("w"),
    )
    moments = co_moments("total_patients", F.col("w") * 100)
    return (
        fac.groupBy("volume_band")
        .agg(F.count(F.lit(1)).alias("num_hospitals"),
             F.sum("w").alias("_s"), F.count("w").alias("_c"), *moments)
        .select("volume_band", "num_hospitals",
                ratio_half_up("_s", "_c", 2).cast("double").alias("mean_weighted_mortality"),
                exact_corr().alias("corr_volume_mortality"))
        .orderBy("volume_band")
    )


# ------------------------------------------------------------------ states ---
def _state_parts(complications, hospitals, min_hospitals=None, max_hospitals=None):
    return group_parts(complications, hospitals, "state", min_hospitals=min_hospitals,
                       max_hospitals=max_hospitals)


def state_ranking(complications: DataFrame, hospitals: DataFrame,
                  min_hospitals: int = MIN_STATE_HOSPITALS) -> DataFrame:
    """States with at least ``min_hospitals`` facilities, ranked on the unrounded
    weighted mean.  The rank window runs over one row per state."""
    parts = _state_parts(complications, hospitals, min_hospitals)
    ranked = with_rank(parts, exact_weighted_key(), "state_rank")
    return ranked.select(
        "state", "num_hospitals",
        weighted_rate().alias("weighted_avg_mortality"),
        rounded_score("_min").alias("best_hospital_score"),
        rounded_score("_max").alias("worst_hospital_score"),
        "state_rank",
    ).orderBy("state_rank", "state")


def state_ranking_rounded(complications: DataFrame, hospitals: DataFrame,
                          min_hospitals: int = MIN_STATE_HOSPITALS,
                          k: int = TOP_STATES) -> DataFrame:
    """Variant: rank on the 2-dp value (more ties), min/max via decimal(10,2),
    first ``k`` states (ties at the cut broken by state)."""
    parts = _state_parts(complications, hospitals, min_hospitals)
    flat = parts.select(
        "state", "num_hospitals",
        weighted_rate().alias("weighted_avg_mortality"),
        rounded_score("_min", as_decimal="decimal(10,2)").alias("best_hospital_score"),
        rounded_score("_max", as_decimal="decimal(10,2)").alias("worst_hospital_score"),
    )
    return top_k(flat, k, "weighted_avg_mortality", "state_rank", tiebreak="state")


def state_chart(complications: DataFrame, hospitals: DataFrame,
                min_hospitals: int = MIN_STATE_CHART) -> DataFrame:
    """All states with at least ``min_hospitals`` facilities, best first."""
    parts = _state_parts(complications, hospitals, min_hospitals)
    return parts.select(
        "state", "num_hospitals", weighted_rate().alias("weighted_avg_mortality")
    ).orderBy("weighted_avg_mortality", "state")


def small_states_excluded(complications: DataFrame, hospitals: DataFrame,
                          min_hospitals: int = MIN_STATE_HOSPITALS) -> DataFrame:
    """States below the ranking threshold, with their sizes and rates."""
    parts = _state_parts(complications, hospitals, max_hospitals=min_hospitals)
    return parts.select(
        "state", "num_hospitals", weighted_rate().alias("weighted_avg_mortality")
    ).orderBy("num_hospitals", "state")


def rank_shift_simple_vs_weighted(complications: DataFrame, hospitals: DataFrame,
                                  min_hospitals: int = MIN_STATE_HOSPITALS) -> DataFrame:
    """State rank by plain mean vs by weighted mean, and the shift between them.

    As in the comparison it reproduces: the plain mean is ranked as computed,
    the weighted mean on its 2-dp value (the rounded state ranking's key).
    """
    parts = _state_parts(complications, hospitals, min_hospitals).select(
        "state", "num_hospitals", "_m_num", "_m_den",
        plain_rate().alias("simple_avg_mortality"),
        weighted_rate().alias("weighted_avg_mortality"))
    ranked = with_rank(with_rank(parts, exact_plain_key(), "simple_rank"),
                       "weighted_avg_mortality", "weighted_rank")
    return ranked.select(
        "state", "num_hospitals", "simple_avg_mortality", "weighted_avg_mortality",
        "simple_rank", "weighted_rank",
        (F.col("weighted_rank") - F.col("simple_rank")).alias("rank_shift"),
    ).orderBy("weighted_rank", "state")


# --------------------------------------------------------------- ownership ---
def _owner_parts(complications, hospitals, min_hospitals=None, max_hospitals=None):
    return group_parts(complications, hospitals, "ownership", min_hospitals=min_hospitals,
                       max_hospitals=max_hospitals)


def ownership_ranking(complications: DataFrame, hospitals: DataFrame,
                      min_hospitals: int | None = MIN_OWNER_HOSPITALS) -> DataFrame:
    """Ownership types (NULL is a type) ranked on the unrounded weighted mean."""
    parts = _owner_parts(complications, hospitals, min_hospitals)
    ranked = with_rank(parts, exact_weighted_key(), "quality_rank")
    return ranked.select(
        "ownership", "num_hospitals",
        weighted_rate().alias("weighted_avg_mortality"),
        rounded_score("_min").alias("best_score"),
        rounded_score("_max").alias("worst_score"),
        "quality_rank",
    ).orderBy("quality_rank", F.col("ownership").asc_nulls_last())


def ownership_ranking_all(complications: DataFrame, hospitals: DataFrame) -> DataFrame:
    return ownership_ranking(complications, hospitals, min_hospitals=None)


def ownership_chart(complications: DataFrame, hospitals: DataFrame,
                    min_hospitals: int = MIN_OWNER_HOSPITALS) -> DataFrame:
    parts = _owner_parts(complications, hospitals, min_hospitals)
    return parts.select(
        "ownership", "num_hospitals", weighted_rate().alias("weighted_avg_mortality")
    ).orderBy("weighted_avg_mortality", F.col("ownership").asc_nulls_last())


def small_groups_excluded(complications: DataFrame, hospitals: DataFrame,
                          min_hospitals: int = MIN_OWNER_HOSPITALS) -> DataFrame:
    """Ownership types below the ranking threshold, with sizes and rates."""
    parts = _owner_parts(complications, hospitals, max_hospitals=min_hospitals)
    return parts.select(
        "ownership", "num_hospitals", weighted_rate().alias("weighted_avg_mortality")
    ).orderBy("num_hospitals", F.col("ownership").asc_nulls_last())


# ---------------------------------------------------------------- national ---
def national_parts(complications: DataFrame, measures=MORTALITY_MEASURES) -> DataFrame:
    """One-row frame with the exact national sums (no dimension join)."""
    clean = clean_mortality(complications, None, measures, join=False)
    return clean.agg(*weighted_parts("score", "denominator"))


def national_value(complications: DataFrame):
    """The national weighted mean (decimal, 2 dp) as a scalar-subquery column."""
    return national_parts(complications).select(weighted_avg("_w")).scalar()


def national_avg(complications: DataFrame, hospitals: DataFrame | None = None) -> DataFrame:
    """Volume-weighted mortality over every facility's five measures, one row."""
    return national_parts(complications).select(
        weighted_rate().alias("national_weighted_avg"))


def _vs_national(complications: DataFrame, hospitals: DataFrame, key: str,
                 min_hospitals: int) -> DataFrame:
    """One read of the facts gives the groups and the national mean, which also
    counts facilities missing from the dimension: the totals are windows over
    one row per group."""
    every = Window.partitionBy()
    parts = group_parts(complications, hospitals, key, keep_orphans=True)
    nat = parts.select(
        "*", F.sum("_w_num").over(every).alias("_n_num"), F.sum("_w_den").over(every).alias("_n_den")
    ).filter(F.col("_in_dim") & (F.col("num_hospitals") >= min_hospitals))
    flagged = nat.select(
        key, "num_hospitals", weighted_rate().alias("weighted_avg_mortality"),
        weighted_avg("_n").cast("double").alias("national_weighted_avg"),
    ).withColumn("below_national", F.col("weighted_avg_mortality") < F.col("national_weighted_avg"))
    below = F.sum(F.col("below_national").cast("long")).over(every)
    return flagged.withColumn(
        "share_below_pct", share_pct(below, F.count(F.lit(1)).over(every), 1)
    ).orderBy("weighted_avg_mortality", F.col(key).asc_nulls_last())


def state_vs_national(complications: DataFrame, hospitals: DataFrame,
                      min_hospitals: int = MIN_STATE_CHART) -> DataFrame:
    """States (chart threshold) flagged below the computed national mean."""
    return _vs_national(complications, hospitals, "state", min_hospitals)


def ownership_vs_national(complications: DataFrame, hospitals: DataFrame,
                          min_hospitals: int = MIN_OWNER_HOSPITALS) -> DataFrame:
    return _vs_national(complications, hospitals, "ownership", min_hospitals)


def gap_to_national(complications: DataFrame, hospitals: DataFrame,
                    measure: str = "MORT_30_AMI", compared: str = WORSE) -> DataFrame:
    """Each outlier's score minus the national weighted mean (2 dp)."""
    nat = national_value(complications)
    rows = outliers(complications, hospitals, measure, compared)
    s = score_value("score")
    return rows.select(
        "facility_id", "facility_name", "state",
        s.cast("double").alias("score"),
        nat.cast("double").alias("national_weighted_avg"),
        (s - nat).cast("double").alias("gap_to_national"),
    ).orderBy(F.desc("score"), "facility_id")


def top_gap_to_national(complications: DataFrame, hospitals: DataFrame, k: int = TOP_FACILITIES,
                        min_measures: int = MIN_MEASURES) -> DataFrame:
    """The top-k facilities' weighted mortality minus the national mean, and
    whether it lies below it."""
    nat = national_value(complications)
    rate = F.col("weighted_avg_mortality").cast("decimal(38,2)")
    return composite_weighted(complications, hospitals, k, min_measures).select(
        "facility_id", "facility_name", "state", "quality_rank", "weighted_avg_mortality",
        nat.cast("double").alias("national_weighted_avg"),
        (rate - nat).cast("double").alias("gap_to_national"),
        (rate < nat).alias("below_national"),
    ).orderBy("quality_rank", "facility_id")


# -------------------------------------------------------------- conditions ---
def _condition_parts(complications, hospitals, with_name=True):
    fact_keys = ("measure_id", "measure_name") if with_name else ("measure_id",)
    return group_parts(complications, hospitals, [*fact_keys, "ownership_group"],
                       fact_keys=fact_keys, dim_attrs=("ownership",),
                       derive={"ownership_group": ownership_group("ownership")})


def mortality_by_condition(complications: DataFrame, hospitals: DataFrame) -> DataFrame:
    """Weighted mortality per measure x ownership group."""
    parts = _condition_parts(complications, hospitals)
    return parts.select(
        "measure_id", "measure_name", "ownership_group",
        weighted_rate().alias("weighted_avg_mortality"), "num_hospitals",
    ).orderBy("measure_id", "weighted_avg_mortality", "ownership_group")


def ownership_rank_by_condition(complications: DataFrame, hospitals: DataFrame) -> DataFrame:
    """Rank of each ownership group within each measure (1 = lowest mortality)."""
    parts = _condition_parts(complications, hospitals).select(
        "measure_id", "ownership_group",
        weighted_rate().alias("weighted_avg_mortality"), "num_hospitals")
    return with_rank(parts, "weighted_avg_mortality", "group_rank",
                     partition_by="measure_id").orderBy("measure_id", "group_rank",
                                                        "ownership_group")


def condition_pivot(complications: DataFrame, hospitals: DataFrame) -> DataFrame:
    """Measure x ownership-group matrix with chart labels; a missing cell is NULL.

    The pivot values are fixed, so no extra job discovers them.
    """
    parts = _condition_parts(complications, hospitals, with_name=False).select(
        "measure_id", "ownership_group", weighted_rate().alias("w"))
    # one value per (measure, group) cell, so max() just lifts it into place
    wide = parts.groupBy("measure_id").pivot("ownership_group", list(OWNERSHIP_GROUPS)) \
        .agg(F.max("w"))
    return wide.select(measure_label("measure_id").alias("label"),
                       *[F.col(f"`{g}`") for g in OWNERSHIP_GROUPS]).orderBy("label")


def va_stroke_eligible(complications: DataFrame, hospitals: DataFrame,
                       measure: str = "MORT_30_STK") -> DataFrame:
    """VA facilities with a reported score for one measure (none is a finding)."""
    return (
        complications.filter((F.col("measure_id") == measure) & reported("score"))
        .select("facility_id").distinct()
        .join(dimension(hospitals), "facility_id")
        .filter(F.col("ownership").like(VETERANS_PATTERN))
        .groupBy("ownership")
        .agg(F.count_distinct("facility_id").alias("n"))
    )


def va_stroke_classes(complications: DataFrame, hospitals: DataFrame,
                      measure: str = "MORT_30_STK") -> DataFrame:
    """VA rows of one measure per comparison class (NULL class kept)."""
    return (
        complications.filter(F.col("measure_id") == measure)
        .groupBy("facility_id", "compared")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(dimension(hospitals), "facility_id")
        .filter(F.col("ownership").like(VETERANS_PATTERN))
        .groupBy("compared")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), F.col("compared").asc_nulls_last())
    )


def clean_rows(complications: DataFrame, hospitals: DataFrame) -> DataFrame:
    """The cleaned, joined mortality rows (score as double for display)."""
    return clean_mortality(complications, hospitals).select(
        "facility_id", "facility_name", "state", "ownership", "measure_id", "measure_name",
        F.col("score").cast("double").alias("score"), "denominator", "compared")

