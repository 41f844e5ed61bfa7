"""A facility holding a third of all fact rows (duplicated measure rows).

Aggregate-then-join, the bitmask distinct count and the roll-ups must equal
the naive join-then-aggregate formulation exactly, duplicates included.
"""

from conftest import comp, hosp
from pyspark.sql import functions as F

from wardrank.operators.clean import clean_mortality
from wardrank.plans import recommend as rec
from wardrank.plans import reports as rep
from wardrank.sources.schema import MORTALITY_MEASURES as M


def _tables(tables):
    hs = [hosp(f"F{i:03d}", state=f"S{i % 3}", ownership="Proprietary") for i in range(60)]
    rows = [comp(f"F{i:03d}", m, f"{9 + (i * 7 + j) % 50 / 10:.1f}", 20 + i + j)
            for i in range(60) for j, m in enumerate(M)]
    hot = [comp("F000", M[j % 5], f"{12 + j % 9 / 10:.1f}", 30 + j % 11) for j in range(150)]
    return tables(hs, rows + hot)


def test_hot_facility_state_rollup_equals_join_first(tables):
    c, h = _tables(tables)
    assert c.filter("facility_id = 'F000'").count() * 3 >= c.count()
    lib = rep.state_chart(c, h, min_hospitals=1)
    naive = clean_mortality(c, h).groupBy("state").agg(
        F.count_distinct("facility_id").alias("num_hospitals"),
        F.round(F.sum(F.col("score") * F.col("denominator")) / F.sum("denominator"), 2)
        .cast("double").alias("weighted_avg_mortality"))
    assert sorted(map(tuple, lib.collect())) == \
        sorted(map(tuple, naive.select(*lib.columns).collect()))


def test_hot_facility_composite_equals_join_first(tables):
    c, h = _tables(tables)
    lib = {r.facility_id: (r.measures_available, r.weighted_avg_mortality, r.total_patients)
           for r in rep.composite_weighted(c, h, k=60).collect()}
    naive = clean_mortality(c, h).groupBy("facility_id").agg(
        F.count_distinct("measure_id").alias("m"),
        F.round(F.sum(F.col("score") * F.col("denominator")) / F.sum("denominator"), 2)
        .cast("double").alias("w"),
        F.sum("denominator").alias("d")).collect()
    assert lib == {r.facility_id: (r.m, r.w, r.d) for r in naive}
    assert lib["F000"][0] == 5


def test_hot_facility_recommendations_keep_all_rows_in_the_cut(tables):
    c, h = _tables(tables)
    top = rec.recommend_all(c, h).filter("state = 'S0' AND measure_id = 'MORT_30_AMI'")
    rows = top.collect()
    assert len(rows) == 5 and [r.recommendation_rank for r in rows][0] == 1
    naive = clean_mortality(c, h).filter("state = 'S0' AND measure_id = 'MORT_30_AMI' "
                                         "AND denominator >= 25") \
        .orderBy("score", "facility_id").limit(5).collect()
    assert [r.facility_id for r in rows] == [r.facility_id for r in naive]
