"""Expose the analyses to SQL users as temporary views.

``register_analyses(spark, complications, hospitals)`` registers the two
tables and every analysis (default parameters) under its query name, so the
questions are answerable in plain Spark SQL::

    SELECT * FROM composite_weighted ORDER BY quality_rank
    SELECT * FROM recommend_all WHERE state = 'NY' AND measure_id = 'MORT_30_AMI'
    SELECT * FROM eligibility_counts WHERE measure_id = 'MORT_30_HF'

Views are lazy plans (nothing runs at registration).  A predicate on a
slice key of ``recommend_all`` is pushed below its partitioned window by
Catalyst, so one slice costs a filtered scan, not a full ranking.

``register_functions`` adds the parameterised questions as SQL table functions::

    SELECT * FROM recommend('NY', 'MORT_30_AMI', k => 5)
    SELECT * FROM eligible_hospitals('MORT_30_HF', in_state => 'MS')

Spark inlines their bodies, so literal arguments become predicates of the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean_mortality
from ..operators.metrics import facility_parts, rounded_score, weighted_rate
from ..sources.files import register_views
from ..sources.schema import MIN_MEASURES, MIN_PATIENTS, TOP_FACILITIES, TOP_RECOMMEND, WORSE
from . import recommend as rec
from . import reports as rep

VIEWS = {
    "clean_mortality": rep.clean_rows,
    "measure_catalog": rep.measure_catalog,
    "measure_distribution": rep.measure_distribution,
    "outliers": rep.outliers,
    "composite_weighted": rep.composite_weighted,
    "composite_ranked": rep.composite_ranked,
    "composite_simple": rep.composite_simple,
    "best_worst_20": rep.best_worst,
    "volume_vs_quality": rep.volume_vs_quality,
    "volume_band_quality": rep.volume_band_quality,
    "state_ranking": rep.state_ranking,
    "state_ranking_rounded": rep.state_ranking_rounded,
    "state_chart": rep.state_chart,
    "small_states_excluded": rep.small_states_excluded,
    "rank_shift_simple_vs_weighted": rep.rank_shift_simple_vs_weighted,
    "ownership_ranking": rep.ownership_ranking,
    "ownership_ranking_all": rep.ownership_ranking_all,
    "ownership_chart": rep.ownership_chart,
    "small_groups_excluded": rep.small_groups_excluded,
    "national_avg": rep.national_avg,
    "state_vs_national": rep.state_vs_national,
    "ownership_vs_national": rep.ownership_vs_national,
    "gap_to_national": rep.gap_to_national,
    "mortality_by_condition": rep.mortality_by_condition,
    "ownership_rank_by_condition": rep.ownership_rank_by_condition,
    "condition_pivot": rep.condition_pivot,
    "va_stroke_eligible": rep.va_stroke_eligible,
    "va_stroke_classes": rep.va_stroke_classes,
    "recommend_all": rec.recommend_all,
    "eligibility_counts": rec.eligibility_counts,
    "recommend_context": rec.recommend_context,
    "top_spread": rec.top_spread,
    "system_repeat": rec.system_repeat,
    "recommend_reliability": rec.recommend_reliability,
    "hospital_systems": rec.hospital_systems,
    "system_repeat_by_name": rec.system_repeat_by_name,
}


def register_analyses(spark: SparkSession, complications: DataFrame, hospitals: DataFrame,
                      prefix: str = "") -> list[str]:
    """Register tables and analyses as temp views; returns the view names."""
    register_views(complications, hospitals, prefix)
    names = [f"{prefix}complications", f"{prefix}hospitals"]
    for name, fn in VIEWS.items():
        fn(complications, hospitals).createOrReplaceTempView(f"{prefix}{name}")
        names.append(f"{prefix}{name}")
    return names


#: name -> (parameters, columns, body); ``{p}`` is the prefix of the tables.
FUNCTIONS = {
    "recommend": (
        f"in_state STRING, in_measure STRING, k INT DEFAULT {TOP_RECOMMEND}, min_patients INT DEFAULT {MIN_PATIENTS}",
        "facility_name STRING, city STRING, hospital_type STRING, ownership STRING, measure_name STRING, "
        "mortality_rate DOUBLE, patients_evaluated BIGINT, compared STRING, recommendation_rank BIGINT",
        """SELECT facility_name, city, hospital_type, ownership, measure_name, CAST(score AS DOUBLE), denominator, compared,
                  CAST(RANK() OVER (ORDER BY score) AS BIGINT)
           FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY score, facility_id) AS place FROM {p}mortality_rows
                 WHERE state = in_state AND measure_id = in_measure AND denominator >= min_patients)
           WHERE place <= k"""),
    "eligible_hospitals": (
        f"in_measure STRING, in_state STRING DEFAULT NULL, min_patients INT DEFAULT {MIN_PATIENTS}",
        "state STRING, total_hospitals BIGINT, eligible_hospitals BIGINT",
        """SELECT state, COUNT(*), COUNT(enough)
           FROM (SELECT state, CASE WHEN patients >= min_patients THEN 1 END AS enough FROM {p}facility_patients
                 WHERE measure_id = in_measure AND (in_state IS NULL OR state = in_state))
           GROUP BY state"""),
    "composite": (
        f"k INT DEFAULT {TOP_FACILITIES}, min_measures INT DEFAULT {MIN_MEASURES}",
        "facility_id STRING, facility_name STRING, state STRING, measures_available BIGINT, weighted_avg_mortality DOUBLE, "
        "best_measure DOUBLE, worst_measure DOUBLE, total_patients BIGINT, quality_rank BIGINT",
        """SELECT facility_id, facility_name, state, measures_available, weighted_avg_mortality, best_measure, worst_measure,
                  total_patients, CAST(RANK() OVER (ORDER BY weighted_avg_mortality NULLS LAST) AS BIGINT)
           FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY weighted_avg_mortality NULLS LAST, facility_id) AS place
                 FROM {p}facility_rates WHERE measures_available >= min_measures)
           WHERE place <= k"""),
    "distribution": (
        "in_measure STRING",
        "compared STRING, num_hospitals BIGINT, pct DOUBLE",
        """SELECT compared, n, CAST((2000 * n + total) DIV (2 * total) AS DOUBLE) / 10
           FROM (SELECT compared, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS total FROM {p}complications
                 WHERE measure_id = in_measure AND compared IS NOT NULL GROUP BY compared)"""),
    "outlier_hospitals": (
        f"in_measure STRING, in_class STRING DEFAULT '{WORSE}'",
        "facility_id STRING, facility_name STRING, state STRING, hospital_type STRING, score STRING, denominator STRING",
        """SELECT c.facility_id, c.facility_name, h.state, h.hospital_type, c.score, c.denominator
           FROM {p}complications c JOIN {p}hospitals h ON c.facility_id = h.facility_id
           WHERE c.measure_id = in_measure AND c.compared = in_class"""),
}


def register_functions(spark: SparkSession, complications: DataFrame, hospitals: DataFrame, prefix: str = "") -> list[str]:
    """Register the parameterised analyses as temporary SQL table functions;
    returns their names.  Nothing runs."""
    register_views(complications, hospitals, prefix)
    base = {
        "mortality_rows": clean_mortality(complications, hospitals),
        "facility_patients": rec.facility_patients(complications, hospitals),
        "facility_rates": facility_parts(complications, hospitals).select(
            "facility_id", "facility_name", "state", F.col("measures_available").cast("long").alias("measures_available"),
            weighted_rate().alias("weighted_avg_mortality"), rounded_score("_min").alias("best_measure"),
            rounded_score("_max").alias("worst_measure"), "total_patients"),
    }
    for name, df in base.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    for name, (parameters, columns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE ({columns}) RETURN "
                  + body.format(p=prefix))
    return [f"{prefix}{name}" for name in FUNCTIONS]
