"""Invariants on the sf0.01 fixture."""

from decimal import Decimal

import pytest
from conftest import SF01
from pyspark.sql import functions as F

from wardrank.operators.clean import clean_mortality
from wardrank.operators.metrics import group_parts
from wardrank.plans import recommend as rec
from wardrank.plans import reports as rep
from wardrank.sources.fixture import cms_fixture


@pytest.fixture(scope="module")
def fx(spark):
    c, h = cms_fixture(spark, SF01)
    return c.cache(), h.cache()


def test_distribution_shares_sum_to_100(fx):
    c, _ = fx
    pcts = [r.pct for r in rep.measure_distribution(c).collect()]
    assert abs(sum(pcts) - 100.0) <= 0.05 * len(pcts)


def test_min_le_weighted_le_max(fx):
    c, h = fx
    for r in rep.state_ranking(c, h, min_hospitals=1).collect():
        assert r.best_hospital_score <= r.weighted_avg_mortality <= r.worst_hospital_score


def test_eligible_le_total_and_context(fx):
    c, h = fx
    for r in rec.eligible_by_state(c, h).collect():
        assert 0 <= r.eligible_hospitals <= r.total_hospitals
    for r in rec.recommend_context(c, h).collect():
        assert r.shown == min(5, r.eligible_hospitals)


def test_rank_one_exists_and_ranks_are_dense_from_one(fx):
    c, h = fx
    assert rep.composite_weighted(c, h).first().quality_rank == 1
    for m in rep.ownership_rank_by_condition(c, h).groupBy("measure_id") \
            .agg(F.min("group_rank").alias("m")).collect():
        assert m.m == 1


def test_national_equals_states_plus_orphans(fx):
    c, h = fx
    states = group_parts(c, h, "state").agg(F.sum("_w_num").alias("w"),
                                            F.sum("_w_den").alias("d")).first()
    orphans = clean_mortality(c, None, join=False).join(h, "facility_id", "left_anti") \
        .agg(F.sum(F.col("score") * F.col("denominator")).alias("w"),
             F.sum("denominator").alias("d")).first()
    w, d = states.w + (orphans.w or 0), states.d + (orphans.d or 0)
    expect = (Decimal(w) / Decimal(d)).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP")
    assert rep.national_avg(c).first().national_weighted_avg == float(expect)


def test_single_slice_is_a_filter_of_all_slices(fx):
    c, h = fx
    every = rec.recommend_all(c, h).filter("state = 'NATION_POOL' AND measure_id = 'MORT_30_PN'")
    one = rec.recommend(c, h, "NATION_POOL", "MORT_30_PN")
    cols = one.columns
    assert sorted(map(tuple, every.select(*cols).collect())) == \
        sorted(map(tuple, one.collect()))


def test_facility_aggregate_first_equals_join_first(fx):
    """Aggregate-then-join (library) equals join-then-aggregate (reference shape)."""
    c, h = fx
    lib = rep.state_chart(c, h, min_hospitals=1)
    joined = clean_mortality(c, h).groupBy("state").agg(
        F.count_distinct("facility_id").alias("num_hospitals"),
        F.round(F.sum(F.col("score") * F.col("denominator")) / F.sum("denominator"), 2)
        .cast("double").alias("weighted_avg_mortality"))
    assert sorted(map(tuple, lib.collect())) == \
        sorted(map(tuple, joined.select(*lib.columns).collect()))
