"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query derives the two CMS-shaped tables from the test tables in
``sf_dir`` (``customer, nation, orders, lineitem``) with Spark, then runs one
analysis over the whole of them.  Parameters that name a state use the
fixture's stand-ins (FIXTURES.md §3): ``NATION_5`` plays NY, ``NATION_POOL``
(the hot state holding ~1/6 of all rows) plays TX, ``NATION_24`` plays MS.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import rejected_rows
from ..session import scratch_path
from ..sources import files
from ..sources.fixture import cms_fixture
from ..sources.schema import COMPLICATION_COLUMNS, HOSPITAL_COLUMNS
from ..sources.sniff import sniff_types
from ..streaming.landing import load_complication_drops
from . import recommend as rec
from . import reports as rep
from .views import register_functions

NY, TX, MS = "NATION_5", "NATION_POOL", "NATION_24"
# total patients stay under 500 below sf0.1, so the tests split at 250
TEST_VOLUME_EDGE = 250

Query = Callable[[SparkSession, str], DataFrame]


def _on_fixture(fn, **params) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        complications, hospitals = cms_fixture(spark, sf_dir)
        return fn(complications, hospitals, **params)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def _scan_csv(which: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        complications, hospitals = cms_fixture(spark, sf_dir)
        root = scratch_path(spark, "csv")
        if which == "hospitals":
            files.write_cms_csv(hospitals, f"{root}/hospitals", HOSPITAL_COLUMNS)
            return files.read_hospitals_csv(spark, f"{root}/hospitals")
        files.write_cms_csv(complications, f"{root}/complications", COMPLICATION_COLUMNS)
        return files.read_complications_csv(spark, f"{root}/complications")
    return run


def _table_roundtrip(which: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        complications, hospitals = cms_fixture(spark, sf_dir)
        root = scratch_path(spark, "tables")
        files.save_tables(complications, hospitals, root)
        return files.load_tables(spark, root)[which]
    return run


def _table_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts after a first load of a part of them was replaced."""
    complications, hospitals = cms_fixture(spark, sf_dir)
    root = scratch_path(spark, "tables")
    files.save_tables(complications.filter("score <> 'Not Available'"), hospitals.limit(0), root)
    files.save_tables(complications, hospitals, root)
    stored, dim = files.load_tables(spark, root)
    return stored.join(dim.select("facility_id"), "facility_id", "left").select(*stored.columns)


def _broken_names(hospitals: DataFrame) -> DataFrame:
    """The dimension with a line break and a quote in each name."""
    return hospitals.withColumn("facility_name", F.regexp_replace("facility_name", " Hospital ", ' "Hospital"\n'))


def _scan_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, hospitals = cms_fixture(spark, sf_dir)
    root = scratch_path(spark, "csv")
    files.write_cms_csv(_broken_names(hospitals).repartition(4, "facility_id"), f"{root}/hospitals", HOSPITAL_COLUMNS)
    return files.read_hospitals_csv(spark, f"{root}/hospitals", line_breaks=True)


def _sniffed(fine: bool, which: str, tolerance: float = 0.0) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        complications, hospitals = cms_fixture(spark, sf_dir)
        root = scratch_path(spark, "csv")
        if which == "hospitals":
            files.write_cms_csv(hospitals, f"{root}/{which}", HOSPITAL_COLUMNS)
            return sniff_types(files.read_hospitals_csv(spark, f"{root}/{which}"), tolerance=tolerance)
        files.write_cms_csv(with_fine_scores(complications) if fine else complications, f"{root}/{which}", COMPLICATION_COLUMNS)
        return sniff_types(files.read_complications_csv(spark, f"{root}/{which}"), tolerance=tolerance)
    return run


def _sql(statement: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_functions(spark, *cms_fixture(spark, sf_dir), prefix="w_")
        return spark.sql(statement)
    return run


def _loads_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measure catalog from the bitmaps of two loads that share facilities."""
    complications, _ = cms_fixture(spark, sf_dir)
    usable = F.coalesce(F.col("score") != "Not Available", F.lit(False))
    return rep.measure_catalog_of_loads([complications.filter(usable), complications.filter(~usable)])


def with_fine_scores(complications: DataFrame) -> DataFrame:
    """The fact table with finer and larger values, as text: scores get two more
    decimals from the facility id (one facility in a hundred 10,000 more),
    counts end in ``.0``, one in a hundred is 3,000,000,000, and one score in a
    hundred does not parse."""
    tail = F.substring(F.col("facility_id"), -2, 2)
    number = F.col("score").rlike("^[0-9]+[.][0-9]$")
    count = F.col("denominator").rlike("^[0-9]+$")
    return complications.withColumns({
        "score": F.when(number & (tail == "01"), F.concat(F.lit("1000"), "score"))
        .when(number & (tail == "02"), F.concat(F.lit("~"), "score"))
        .when(number, F.concat("score", tail)).otherwise(F.col("score")),
        "denominator": F.when(count & (tail == "03"), F.lit("3000000000"))
        .when(count, F.concat("denominator", F.lit(".0"))).otherwise(F.col("denominator")),
    })


def _on_fine_scores(fn, **params) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        complications, hospitals = cms_fixture(spark, sf_dir)
        return fn(with_fine_scores(complications), hospitals, **params)
    return run


def with_mixed_names(hospitals: DataFrame) -> DataFrame:
    """The dimension with dedications and generic names among those of systems."""
    tail = F.substring(F.col("facility_id"), -1, 1)
    return hospitals.withColumn(
        "facility_name",
        F.when(tail == "1", "St. Mary Medical Center").when(tail == "2", F.concat(F.lit("Memorial Hospital - "), "state"))
        .otherwise(F.col("facility_name")))


def _on_mixed_names(fn, **params) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        complications, hospitals = cms_fixture(spark, sf_dir)
        return fn(complications, with_mixed_names(hospitals), **params)
    return run


def _stream_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV drops of the fact table loaded by the streaming loader (availableNow)."""
    complications, _ = cms_fixture(spark, sf_dir)
    root = scratch_path(spark, "stream")
    files.write_cms_csv(complications, f"{root}/landing", COMPLICATION_COLUMNS)
    query = load_complication_drops(spark, f"{root}/landing", f"{root}/table",
                                    list(COMPLICATION_COLUMNS), checkpoint=f"{root}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{root}/table")


def _preview(which: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        complications, hospitals = cms_fixture(spark, sf_dir)
        if which == "hospitals":
            return files.preview(hospitals, "facility_id")
        return files.preview(complications, ["facility_id", "measure_id"])
    return run


QUERIES: dict[str, Query] = {
    # sources, catalog
    "table_counts": _on_fixture(files.table_counts),
    "preview_hospitals": _preview("hospitals"),
    "preview_complications": _preview("complications"),
    "scan_csv": _scan_csv("hospitals"),
    "scan_csv_complications": _scan_csv("complications"),
    "table_roundtrip": _table_roundtrip(0),
    "table_roundtrip_hospitals": _table_roundtrip(1),
    "table_replaced": _table_replaced,
    "scan_csv_line_breaks": _scan_line_breaks,
    "sniff_hospitals": _sniffed(False, "hospitals"),
    "sniff_complications": _sniffed(False, "complications"),
    "sniff_fine_scores": _sniffed(True, "complications", tolerance=0.05),
    "stream_load": _stream_load,
    # cleaning, catalog, distribution
    "clean_mortality": _on_fixture(rep.clean_rows),
    "rejected_rows": _on_fine_scores(lambda c, h: rejected_rows(c)),
    "fine_scores_clean": _on_fine_scores(rep.clean_rows),
    "fine_scores_states": _on_fine_scores(rep.state_ranking),
    "fine_scores_gap": _on_fine_scores(rep.gap_to_national),
    "measure_catalog": _on_fixture(rep.measure_catalog),
    "measure_catalog_of_loads": _loads_catalog,
    "measure_distribution": _on_fixture(rep.measure_distribution),
    "outliers": _on_fixture(rep.outliers),
    # facilities
    "composite_weighted": _on_fixture(rep.composite_weighted),
    "composite_ranked": _on_fixture(rep.composite_ranked),
    "composite_simple": _on_fixture(rep.composite_simple),
    "best_worst_20": _on_fixture(rep.best_worst),
    "volume_vs_quality": _on_fixture(rep.volume_vs_quality),
    "volume_band_quality": _on_fixture(rep.volume_band_quality, edge=TEST_VOLUME_EDGE),
    "volume_band_quality_default": _on_fixture(rep.volume_band_quality),
    # states
    "state_ranking": _on_fixture(rep.state_ranking),
    "state_ranking_rounded": _on_fixture(rep.state_ranking_rounded),
    "state_chart": _on_fixture(rep.state_chart),
    "small_states_excluded": _on_fixture(rep.small_states_excluded),
    "rank_shift_simple_vs_weighted": _on_fixture(rep.rank_shift_simple_vs_weighted),
    # ownership
    "ownership_ranking": _on_fixture(rep.ownership_ranking),
    "ownership_ranking_all": _on_fixture(rep.ownership_ranking_all),
    "ownership_chart": _on_fixture(rep.ownership_chart),
    "small_groups_excluded": _on_fixture(rep.small_groups_excluded),
    # national benchmark
    "national_avg": _on_fixture(rep.national_avg),
    "state_vs_national": _on_fixture(rep.state_vs_national),
    "ownership_vs_national": _on_fixture(rep.ownership_vs_national),
    "top_gap_to_national": _on_fixture(rep.top_gap_to_national),
    "gap_to_national": _on_fixture(rep.gap_to_national),
    # conditions
    "mortality_by_condition": _on_fixture(rep.mortality_by_condition),
    "ownership_rank_by_condition": _on_fixture(rep.ownership_rank_by_condition),
    "condition_pivot": _on_fixture(rep.condition_pivot),
    "va_stroke_eligible": _on_fixture(rep.va_stroke_eligible),
    "va_heart_failure_eligible": _on_fixture(rep.va_stroke_eligible, measure="MORT_30_HF"),
    "va_stroke_classes": _on_fixture(rep.va_stroke_classes),
    # recommendation
    "recommend_ny_ami": _on_fixture(rec.recommend, state=NY, measure="MORT_30_AMI"),
    "recommend_tx_pn": _on_fixture(rec.recommend, state=TX, measure="MORT_30_PN"),
    "recommend_ms_hf": _on_fixture(rec.recommend, state=MS, measure="MORT_30_HF"),
    "recommend_gap": _on_fixture(rec.recommend_gap, state=NY, measure="MORT_30_AMI"),
    "recommend_gap_tx_pn": _on_fixture(rec.recommend_gap, state=TX, measure="MORT_30_PN"),
    "eligible_by_state": _on_fixture(rec.eligible_by_state, measure="MORT_30_HF"),
    "eligible_one_state": _on_fixture(rec.eligible_one_state, state=MS, measure="MORT_30_HF"),
    "recommend_all": _on_fixture(rec.recommend_all),
    "recommend_context": _on_fixture(rec.recommend_context),
    "top_spread": _on_fixture(rec.top_spread),
    "system_repeat": _on_fixture(rec.system_repeat),
    "recommend_reliability": _on_fixture(rec.recommend_reliability),
    "hospital_systems": _on_mixed_names(rec.hospital_systems),
    "system_repeat_by_name": _on_mixed_names(rec.system_repeat_by_name),
    # SQL table functions
    "sql_recommend": _sql(f"SELECT * FROM w_recommend('{NY}', 'MORT_30_AMI', 5)"),
    "sql_eligible": _sql(f"SELECT * FROM w_eligible_hospitals('MORT_30_HF', in_state => '{MS}')"),
    "sql_eligible_by_state": _sql("SELECT * FROM w_eligible_hospitals('MORT_30_HF')"),
    "sql_composite": _sql("SELECT * FROM w_composite(k => 20, min_measures => 4)"),
    "sql_distribution": _sql("SELECT * FROM w_distribution('MORT_30_AMI')"),
    "sql_outliers": _sql("SELECT * FROM w_outlier_hospitals('MORT_30_AMI')"),
}
