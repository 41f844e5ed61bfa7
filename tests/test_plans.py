"""Physical-plan properties that matter at scale (checked on stored tables)."""

import pytest
from conftest import SF001, plan_text

from wardrank.operators.clean import eligible_rows
from wardrank.operators.ranking import top_k
from wardrank.plans import recommend as rec
from wardrank.plans import reports as rep
from wardrank.sources import files
from wardrank.sources.fixture import cms_fixture


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stored"))
    files.save_tables(*cms_fixture(spark, SF001), root)
    return files.load_tables(spark, root)


def test_filters_reach_the_scan(stored):
    c, h = stored
    plan = plan_text(rep.composite_weighted(c, h))
    assert "PartitionFilters: [measure_id" in plan            # partition pruning
    assert "Not(In(score, [Not Applicable,Not Available]))" in plan
    assert "Not(In(denominator, [Not Applicable,Not Available]))" in plan
    assert "ReadSchema: struct<facility_id:string,facility_name:string,denominator:string," \
           "score:string>" in plan                            # column pruning


def test_global_top_k_limits_before_the_single_partition(stored):
    c, h = stored
    plan = plan_text(rep.composite_weighted(c, h))
    assert "TakeOrderedAndProject" in plan or "GlobalLimit" in plan
    # the facility aggregate uses one shuffle (bitmask distinct count)
    assert plan.count("hashpartitioning(facility_id") == 1


def test_recommend_all_is_partitioned_and_never_single_partition(stored):
    c, h = stored
    plan = plan_text(rec.recommend_all(c, h))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "row_number(), 5, Partial" in plan      # ties do not pass the cut
    assert "SinglePartition" not in plan
    assert "hashpartitioning(state" in plan


def test_ties_of_a_hot_slice_do_not_pass_the_shuffle(spark, tables):
    """100,000 equal scores in one slice: each task moves at most k rows."""
    from conftest import hosp
    from pyspark.sql import functions as F
    n = 100_000
    _, h = tables([hosp("x")], [])
    ids = spark.range(0, n, 1, 4).select("id", F.format_string("F%06d", "id").alias("facility_id"))
    h = ids.select("facility_id", F.col("facility_id").alias("facility_name"), F.lit("C").alias("city"),
                   F.format_string("S%d", F.col("id") % 1).alias("state"), F.lit("T").alias("hospital_type"),
                   F.lit("Proprietary").alias("ownership"))
    c = ids.select("facility_id", F.col("facility_id").alias("facility_name"),
                   F.lit("MORT_30_AMI").alias("measure_id"), F.lit("m").alias("measure_name"),
                   F.lit(None).cast("string").alias("compared"), F.lit("50").alias("denominator"),
                   F.lit("9.0").alias("score"))
    rows = eligible_rows(c, h)
    out = top_k(rows, 5, "score", "r", tiebreak="facility_id", partition_by=["state", "measure_id"])
    got = out.collect()
    assert [r.facility_id for r in sorted(got, key=lambda r: r.facility_id)] == [f"F{i:06d}" for i in range(5)]
    assert {r.r for r in got} == {1}
    plan = plan_text(out, "formatted")
    assert plan.count("row_number(), 5,") >= 2


def test_the_full_ranking_and_reliability_read_the_facts_once(stored):
    c, h = stored
    plan = plan_text(rep.composite_ranked(c, h))
    assert plan.count("complications") == 0        # ranked from the stored facility scores


def test_measure_groups_meet_the_dimension_after_aggregation(spark, stored):
    c, h = stored
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (rep.mortality_by_condition(c, h), rec.eligible_by_state(c, h),
                   rep.va_stroke_classes(c, h), rep.va_stroke_eligible(c, h)):
            lines = plan_text(df, "simple").splitlines()
            scan = next(i for i, x in enumerate(lines) if "complications" in x or "measure_id" in x and "FileScan" in x)
            join = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
            between = "\n".join(lines[join:scan])
            assert "HashAggregate" in between
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_slice_predicates_pushed_below_the_window(stored):
    c, h = stored
    plan = plan_text(rec.recommend(c, h, "NATION_5", "MORT_30_AMI"))
    assert "PartitionFilters: [isnotnull(measure_id" in plan and "MORT_30_AMI" in plan
    assert "PushedFilters: [IsNotNull(state), EqualTo(state,NATION_5)" in plan


def test_best_worst_has_no_window_over_facilities(spark, stored):
    """The stored rates are filtered in place; only the edges, which are
    subqueries over at most k values, have a running count."""
    c, h = stored
    df = rep.best_worst(c, h)
    df.collect()
    main = plan_text(df).split("===== Subqueries =====")[0]
    assert "Window" not in main and "hashpartitioning(facility_id" not in main


def test_no_python_udfs_anywhere(stored):
    c, h = stored
    for fn in (rep.composite_weighted, rep.state_ranking, rec.recommend_all,
               rep.condition_pivot, rec.recommend_reliability):
        plan = plan_text(fn(c, h))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_no_cartesian_python_or_expand_in_any_analysis(stored):
    import bench
    c, h = stored
    for name, (fn, params) in bench.ANALYSES.items():
        plan = plan_text(fn(c, h, **params))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                    "ArrowEvalPython", "Expand"):
            assert bad not in plan, (name, bad)
