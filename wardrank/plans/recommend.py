"""Provider recommendation: top-k facilities per (state, measure) slice.

:func:`recommend_all` ranks **every** slice in one job with a window
partitioned by (state, measure_id); a single-slice recommendation is the same
plan with the slice predicates applied first (they are pushed into the scans,
below the window).  ``row_number() <= k`` becomes a partial
``WindowGroupLimit`` in each map task, so a slice that holds a large share of
all rows is cut to k rows per task before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import lowest, ratio_half_up, share_pct
from ..functions.casts import count_value, reported, score_value
from ..functions.labels import fixed1
from ..operators.clean import clean_mortality, dimension, eligible_rows
from ..operators.ranking import top_k
from ..operators.reduce import near_keys
from ..operators.systems import systems_by_name
from ..sources.schema import BETTER, MIN_PATIENTS, MORTALITY_MEASURES, TOP_RECOMMEND

SLICE = ("state", "measure_id")

OUTPUT = (
    "facility_name", "city", "hospital_type", "ownership", "measure_name",
    "mortality_rate", "patients_evaluated", "compared", "recommendation_rank",
)
GAP_OUTPUT = (
    "facility_name", "city", "mortality_rate", "patients_evaluated", "gap_vs_best",
    "pct_worse_than_best", "compared", "recommendation_rank",
)


def _top(rows: DataFrame, k: int) -> DataFrame:
    """Top-k per slice (LIMIT semantics, ties at the cut by facility_id), with
    the slice's best score ``_best`` (a window over <= k rows per slice)."""
    top = top_k(rows, k, "score", "recommendation_rank", partition_by=list(SLICE),
                tiebreak="facility_id")
    return top.withColumn("_best", F.min("score").over(Window.partitionBy(*SLICE)))


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """:func:`_top` with display columns and the gap to #1."""
    return _shown(_top(rows, k))


def _shown(top: DataFrame, *more: str) -> DataFrame:
    diff = ratio_half_up(F.col("score") - F.col("_best"), F.lit(1), 1)
    pct = ratio_half_up((F.col("score") - F.col("_best")) * 100, "_best", 1)
    return top.select(
        "state", "measure_id", "facility_id", "facility_name", "city", "hospital_type",
        "ownership", "measure_name",
        F.col("score").cast("double").alias("mortality_rate"),
        F.col("denominator").alias("patients_evaluated"),
        "compared", "recommendation_rank",
        fixed1(diff).alias("gap_vs_best"),
        fixed1(pct).alias("pct_worse_than_best"),
        *more,
    )


def recommend_all(complications: DataFrame, hospitals: DataFrame, k: int = TOP_RECOMMEND,
                  min_patients: int = MIN_PATIENTS, measures=MORTALITY_MEASURES) -> DataFrame:
    """Top-k recommendations for every state x measure at once."""
    rows = eligible_rows(complications, hospitals, measures, min_patients)
    return _ranked(rows, k).orderBy("state", "measure_id", "recommendation_rank",
                                    "facility_id")


def recommend_slice(complications: DataFrame, hospitals: DataFrame, state: str, measure: str,
                    k: int = TOP_RECOMMEND, min_patients: int = MIN_PATIENTS) -> DataFrame:
    rows = eligible_rows(complications, hospitals, min_patients=min_patients,
                         state=state, measure=measure)
    return _ranked(rows, k)


def recommend(complications: DataFrame, hospitals: DataFrame, state: str, measure: str,
              k: int = TOP_RECOMMEND, min_patients: int = MIN_PATIENTS) -> DataFrame:
    """Top-k facilities for one state and measure, with at least ``min_patients``."""
    return recommend_slice(complications, hospitals, state, measure, k, min_patients) \
        .orderBy("recommendation_rank", "facility_id").select(*OUTPUT)


def recommend_gap(complications: DataFrame, hospitals: DataFrame, state: str, measure: str,
                  k: int = TOP_RECOMMEND, min_patients: int = MIN_PATIENTS) -> DataFrame:
    """:func:`recommend` plus the gap to #1 in points and in % (one-decimal text)."""
    return recommend_slice(complications, hospitals, state, measure, k, min_patients) \
        .orderBy("recommendation_rank", "facility_id").select(*GAP_OUTPUT)


# --------------------------------------------------------------- context ---
def _facility_eligibility(complications: DataFrame, hospitals: DataFrame, measures,
                          min_patients: int, state: str | None = None) -> DataFrame:
    """One row per (state, measure, facility) with an ``eligible`` 0/1 flag.

    This is the exact form of ``COUNT(DISTINCT CASE WHEN cond THEN id END)``
    next to ``COUNT(DISTINCT id)``: the facts are reduced to one flag per
    (facility, measure), by partial aggregation, before they meet the
    dimension; facilities and flags are then counted per group.  A row is
    eligible on the terms of ``eligible_rows``: both values are reported and
    parse, and there are enough patients.  For one ``state`` the facts are
    reduced to its facilities in the scan (``operators.reduce``).
    """
    dim = dimension(hospitals).select("facility_id", "state")
    if state is not None:
        dim = dim.filter(F.col("state") == state)
        complications = near_keys(complications, "facility_id", dim)
    cond = reported("score") & score_value("score").isNotNull() & reported("denominator") \
        & (count_value("denominator") >= min_patients)
    flags = complications.filter(F.col("measure_id").isin(*measures)) \
        .groupBy("measure_id", "facility_id").agg(
            F.max(F.coalesce(cond, F.lit(False)).cast("int")).alias("eligible"))
    return flags.join(dim, "facility_id")


def facility_patients(complications: DataFrame, hospitals: DataFrame, measures=MORTALITY_MEASURES) -> DataFrame:
    """One row per (state, measure, facility): the most patients of a row with
    a usable score and count, NULL if there is none.  Any threshold on the
    patients can be applied to it."""
    usable = reported("score") & score_value("score").isNotNull() & reported("denominator")
    most = complications.filter(F.col("measure_id").isin(*measures)).groupBy("measure_id", "facility_id").agg(
        F.max(F.when(usable, count_value("denominator"))).alias("patients"))
    return most.join(dimension(hospitals).select("facility_id", "state"), "facility_id").select(
        "state", "measure_id", "facility_id", "patients")


def eligibility_counts(complications: DataFrame, hospitals: DataFrame,
                       measures=MORTALITY_MEASURES, min_patients: int = MIN_PATIENTS,
                       state: str | None = None) -> DataFrame:
    """Per (state, measure): total and eligible facilities."""
    fac = _facility_eligibility(complications, hospitals, measures, min_patients, state)
    return fac.groupBy(*SLICE).agg(
        F.count(F.lit(1)).alias("total_hospitals"),
        F.sum("eligible").cast("long").alias("eligible_hospitals"))


def eligible_by_state(complications: DataFrame, hospitals: DataFrame,
                      measure: str = "MORT_30_HF", min_patients: int = MIN_PATIENTS,
                      state: str | None = None) -> DataFrame:
    """Per state: facilities reporting ``measure`` and those eligible for ranking."""
    return eligibility_counts(complications, hospitals, (measure,), min_patients, state) \
        .select("state", "total_hospitals", "eligible_hospitals") \
        .orderBy(F.desc("eligible_hospitals"), "state")


def eligible_one_state(complications: DataFrame, hospitals: DataFrame, state: str,
                       measure: str = "MORT_30_HF",
                       min_patients: int = MIN_PATIENTS) -> DataFrame:
    return eligible_by_state(complications, hospitals, measure, min_patients, state)


def recommend_context(complications: DataFrame, hospitals: DataFrame, k: int = TOP_RECOMMEND,
                      min_patients: int = MIN_PATIENTS,
                      measures=MORTALITY_MEASURES) -> DataFrame:
    """Per slice: how many are shown (<= k) as a share of the eligible facilities."""
    counts = eligibility_counts(complications, hospitals, measures, min_patients)
    shown = F.least(F.lit(k).cast("long"), F.col("eligible_hospitals"))
    return counts.select(
        "state", "measure_id", "total_hospitals", "eligible_hospitals",
        shown.alias("shown"),
        share_pct(shown, "eligible_hospitals", 1).alias("top_share_pct"),
    ).orderBy("state", "measure_id")


def top_spread(complications: DataFrame, hospitals: DataFrame, k: int = TOP_RECOMMEND,
               min_patients: int = MIN_PATIENTS) -> DataFrame:
    """Per slice: #1 rate, last shown rate and how much worse the last is (%)."""
    top = _top(eligible_rows(complications, hospitals, min_patients=min_patients), k)
    per = top.groupBy(*SLICE).agg(
        F.count(F.lit(1)).alias("n_shown"),
        F.min("score").alias("_b"),
        F.max("score").alias("_l"),
    )
    return per.select(
        "state", "measure_id", "n_shown",
        F.col("_b").cast("double").alias("best_rate"),
        F.col("_l").cast("double").alias("last_rate"),
        ratio_half_up((F.col("_l") - F.col("_b")) * 100, "_b", 1).cast("double")
        .alias("spread_pct"),
    ).orderBy("state", "measure_id")


def system_repeat(complications: DataFrame, hospitals: DataFrame, k: int = TOP_RECOMMEND,
                  min_patients: int = MIN_PATIENTS) -> DataFrame:
    """Systems (first two words of the name) shown more than once in a slice's top-k."""
    top = _ranked(eligible_rows(complications, hospitals, min_patients=min_patients), k)
    return (
        top.withColumn("system", F.substring_index("facility_name", " ", 2))
        .groupBy("state", "measure_id", "system")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .orderBy("state", "measure_id", "system")
    )


def system_repeat_by_name(complications: DataFrame, hospitals: DataFrame, k: int = TOP_RECOMMEND,
                          min_patients: int = MIN_PATIENTS, min_support: int = 3) -> DataFrame:
    """Systems shown more than once in a slice's top-k, a system being the
    longest prefix of words that ``min_support`` facilities share
    (``operators.systems``)."""
    top = _top(eligible_rows(complications, hospitals, min_patients=min_patients), k)
    systems = systems_by_name(hospitals, min_support).select("facility_id", "system")
    return (
        top.select(*SLICE, "facility_id").join(systems, "facility_id")
        .filter(F.col("system").isNotNull())
        .groupBy(*SLICE, "system")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .orderBy("state", "measure_id", "system")
    )


def hospital_systems(complications: DataFrame, hospitals: DataFrame, min_support: int = 3) -> DataFrame:
    """The system of every facility by its name; NULL if it is of none."""
    return systems_by_name(hospitals, min_support)


def _top_and_eligible(complications: DataFrame, hospitals: DataFrame, k: int, min_patients: int,
                      measures=MORTALITY_MEASURES) -> DataFrame:
    """:func:`_top` with the slice's ``eligible_hospitals``, from one read of the facts.

    One aggregate state holds the k best rows, and for a slice also the count
    of its facilities.  It is built per facility first (the count is of
    facilities, not of rows) and then per slice, in the map tasks both times,
    so a task moves at most k rows of a slice, however many it has read.  Rows
    that tie in score and facility are taken in the order of their other
    columns.
    """
    rows = clean_mortality(complications, hospitals, measures, join=False) \
        .filter(F.col("denominator") >= min_patients)
    row = F.struct("score", "facility_id", "denominator", "facility_name", "measure_name", "compared")
    facilities = rows.groupBy("measure_id", "facility_id").agg(lowest(row, k).alias("_rows")) \
        .join(dimension(hospitals), "facility_id")
    best = facilities.select("*", F.posexplode("_rows").alias("_at", "_row"))
    row = F.struct("_row.*", "city", "hospital_type", "ownership")
    slices = best.groupBy(*SLICE).agg(
        F.count(F.when(F.col("_at") == 0, 1)).alias("eligible_hospitals"),
        lowest(row, k).alias("_rows"))
    # within a slice the rows are in order of score: its rank is 1 + lower scores
    rank = F.size(F.filter("_rows", lambda r: r["score"] < F.col("_row.score"))) + 1
    return slices.select("*", F.explode("_rows").alias("_row")).select(
        *SLICE, "eligible_hospitals", "_row.*", rank.cast("long").alias("recommendation_rank"),
        F.col("_rows")[0]["score"].alias("_best"))


def recommend_reliability(complications: DataFrame, hospitals: DataFrame,
                          k: int = TOP_RECOMMEND,
                          min_patients: int = MIN_PATIENTS) -> DataFrame:
    """Each recommendation with its slice's eligible count, gap and whether the
    facility is certified better than the national rate."""
    return (
        _shown(_top_and_eligible(complications, hospitals, k, min_patients), "eligible_hospitals")
        .select(
            "state", "measure_id", "facility_id", "facility_name", "recommendation_rank",
            "mortality_rate", "patients_evaluated", "eligible_hospitals",
            "gap_vs_best", "pct_worse_than_best",
            F.coalesce(F.col("compared") == BETTER, F.lit(False)).alias("certified_better"),
        )
        .orderBy("state", "measure_id", "recommendation_rank", "facility_id")
    )
