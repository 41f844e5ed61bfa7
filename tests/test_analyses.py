"""Hand-made rows: thresholds on both sides, ties at the cut, sentinels, NULLs."""

from conftest import comp, hosp

from wardrank.operators.clean import clean_mortality
from wardrank.plans import recommend as rec
from wardrank.plans import reports as rep
from wardrank.sources.schema import MORTALITY_MEASURES

M = MORTALITY_MEASURES


def test_clean_drops_sentinels_nulls_junk_and_other_measures(tables):
    c, h = tables(
        [hosp("F1")],
        [comp("F1", "MORT_30_AMI", "12.7", 300),
         comp("F1", "MORT_30_HF", "Not Available", 300),
         comp("F1", "MORT_30_PN", "10.0", "Not Applicable"),
         comp("F1", "MORT_30_STK", None, 50),
         comp("F1", "MORT_30_COPD", "abc", 50),
         comp("F1", "COMP_OTHER", "9.9", 40),
         comp("F9", "MORT_30_AMI", "8.0", 40)])  # orphan: not in the dimension
    rows = clean_mortality(c, h).collect()
    assert [(r.measure_id, float(r.score), r.denominator) for r in rows] == [
        ("MORT_30_AMI", 12.7, 300)]
    unjoined = clean_mortality(c, None, join=False).collect()
    assert sorted(r.facility_id for r in unjoined) == ["F1", "F9"]


def test_numeric_score_with_sentinel_denominator_is_not_eligible(tables):
    c, h = tables([hosp("F1", state="MS")],
                  [comp("F1", "MORT_30_HF", "9.3", "Not Available")])
    out = rec.eligible_by_state(c, h, measure="MORT_30_HF").collect()
    assert [(r.state, r.total_hospitals, r.eligible_hospitals) for r in out] == [("MS", 1, 0)]


def test_min_measures_threshold_3_vs_4(tables):
    rows = [comp("F3", m, "10.0", 100) for m in M[:3]] + \
           [comp("F4", m, "11.0", 100) for m in M[:4]]
    c, h = tables([hosp("F3"), hosp("F4")], rows)
    out = rep.composite_weighted(c, h).collect()
    assert [(r.facility_id, r.measures_available, r.quality_rank) for r in out] == [("F4", 4, 1)]


def test_weighted_mean_rounds_exactly(tables):
    rows = [comp("F1", M[0], "10.0", 1), comp("F1", M[1], "10.1", 19),
            comp("F1", M[2], "10.1", 0), comp("F1", M[3], "10.1", 0)]
    c, h = tables([hosp("F1")], rows)
    r = rep.composite_weighted(c, h).first()
    assert r.weighted_avg_mortality == 10.10 and r.total_patients == 20


def test_zero_total_weight_gives_null_and_ranks_last(tables):
    zero = [comp("F0", m, "5.0", 0) for m in M[:4]]
    ok = [comp("F1", m, "9.0", 10) for m in M[:4]]
    c, h = tables([hosp("F0"), hosp("F1")], zero + ok)
    out = rep.composite_weighted(c, h).collect()
    assert [(r.facility_id, r.weighted_avg_mortality, r.quality_rank) for r in out] == [
        ("F1", 9.0, 1), ("F0", None, 2)]


def test_state_threshold_9_vs_10(tables):
    hs = [hosp(f"A{i}", state="AA") for i in range(9)] + \
         [hosp(f"B{i}", state="BB") for i in range(10)]
    cs = [comp(r[0], M[0], "10.0", 50) for r in hs]
    c, h = tables(hs, cs)
    assert [r.state for r in rep.state_ranking(c, h).collect()] == ["BB"]
    assert [r.state for r in rep.small_states_excluded(c, h).collect()] == ["AA"]
    assert sorted(r.state for r in rep.state_chart(c, h).collect()) == ["AA", "BB"]


def test_ownership_threshold_39_vs_40(tables):
    hs = [hosp(f"P{i}", ownership="Proprietary") for i in range(39)] + \
         [hosp(f"V{i}", ownership="Veterans Health Administration") for i in range(40)] + \
         [hosp("N0", ownership=None)]
    cs = [comp(r[0], M[1], "12.0", 30) for r in hs]
    c, h = tables(hs, cs)
    assert [r.ownership for r in rep.ownership_ranking(c, h).collect()] == [
        "Veterans Health Administration"]
    allrows = {r.ownership: r.num_hospitals for r in rep.ownership_ranking_all(c, h).collect()}
    assert allrows == {"Proprietary": 39, "Veterans Health Administration": 40, None: 1}


def test_ties_at_the_top5_cut(tables):
    scores = ["6.0", "6.0", "6.1", "6.1", "6.1", "6.1", "6.2"]
    hs = [hosp(f"F{i}", state="NY") for i in range(7)]
    cs = [comp(f"F{i}", "MORT_30_AMI", s, 100) for i, s in enumerate(scores)]
    c, h = tables(hs, cs)
    out = rec.recommend(c, h, "NY", "MORT_30_AMI").collect()
    assert [r.recommendation_rank for r in out] == [1, 1, 3, 3, 3]
    assert [r.facility_name for r in out] == [f"Hosp F{i}" for i in range(5)]
    every = rec.recommend_all(c, h).collect()
    assert len(every) == 5
    gaps = rec.recommend_gap(c, h, "NY", "MORT_30_AMI").collect()
    assert [(g.gap_vs_best, g.pct_worse_than_best) for g in gaps][-1] == ("0.1", "1.7")


def test_min_patients_24_vs_25(tables):
    hs = [hosp("F24", state="NY"), hosp("F25", state="NY")]
    cs = [comp("F24", "MORT_30_AMI", "5.0", 24), comp("F25", "MORT_30_AMI", "9.0", 25)]
    c, h = tables(hs, cs)
    assert [r.facility_name for r in rec.recommend(c, h, "NY", "MORT_30_AMI").collect()] == [
        "Hosp F25"]


def test_best_and_worst_lists_overlap_twice(tables):
    hs = [hosp(f"F{i:02d}", state="ST") for i in range(25)]
    cs = [comp(f"F{i:02d}", m, f"{8 + i * 0.1:.1f}", 50) for i in range(25) for m in M[:4]]
    c, h = tables(hs, cs)
    out = rep.best_worst(c, h).collect()
    assert len(out) == 40
    both = [r.hospital for r in out if r.category == "Top 20"]
    worst = [r.hospital for r in out if r.category == "Bottom 20"]
    assert len(set(both) & set(worst)) == 15


def test_distribution_pct_and_null_class(tables):
    cs = [comp(f"F{i}", "MORT_30_AMI", "10.0", 50, compared=cl)
          for i, cl in enumerate(["A", "A", "B", None])]
    c, h = tables([], cs)
    out = {r.compared: (r.num_hospitals, r.pct) for r in rep.measure_distribution(c).collect()}
    assert out == {"A": (2, 66.7), "B": (1, 33.3)}


def test_va_stroke_finding_and_null_class(tables):
    hs = [hosp("V1", ownership="Veterans Health Administration"),
          hosp("V2", ownership="Veterans Health Administration"),
          hosp("P1", ownership="Proprietary")]
    cs = [comp("V1", "MORT_30_STK", "Not Available", "Not Available", compared="Not Available"),
          comp("V2", "MORT_30_STK", "Not Applicable", "Not Applicable", compared=None),
          comp("P1", "MORT_30_STK", "14.0", 80)]
    c, h = tables(hs, cs)
    assert rep.va_stroke_eligible(c, h).count() == 0
    got = {r.compared: r.n for r in rep.va_stroke_classes(c, h).collect()}
    assert got == {"Not Available": 1, None: 1}
    piv = {r.label: r for r in rep.condition_pivot(c, h).collect()}
    assert piv["Stroke"]["VA"] is None and piv["Stroke"]["For-profit"] == 14.0


def test_national_includes_orphans_and_flags(tables):
    hs = [hosp(f"A{i}", state="AA") for i in range(5)] + [hosp(f"B{i}", state="BB") for i in range(5)]
    cs = [comp(f"A{i}", M[0], "10.0", 100) for i in range(5)] + \
         [comp(f"B{i}", M[0], "14.0", 100) for i in range(5)] + \
         [comp("ORPHAN", M[0], "30.0", 1000)]
    c, h = tables(hs, cs)
    nat = rep.national_avg(c, h).first().national_weighted_avg
    assert nat == round((10 * 500 + 14 * 500 + 30 * 1000) / 2000, 2)
    flags = {r.state: (r.below_national, r.share_below_pct)
             for r in rep.state_vs_national(c, h).collect()}
    assert flags == {"AA": (True, 100.0), "BB": (True, 100.0)}


def test_rank_shift(tables):
    # state S: small good hospital + big bad one; weighting flips the order vs T
    hs = [hosp(f"S{i}", state="S") for i in range(10)] + [hosp(f"T{i}", state="T") for i in range(10)]
    cs = [comp(f"S{i}", M[0], "8.0" if i else "16.0", 10 if i else 1000) for i in range(10)] + \
         [comp(f"T{i}", M[0], "11.0", 100) for i in range(10)]
    c, h = tables(hs, cs)
    out = {r.state: (r.simple_rank, r.weighted_rank, r.rank_shift)
           for r in rep.rank_shift_simple_vs_weighted(c, h).collect()}
    assert out == {"S": (1, 2, 1), "T": (2, 1, -1)}


def test_system_repeat_and_context(tables):
    hs = [hosp(f"F{i}", state="TX", name=f"Sys {i % 2} Hospital {i}") for i in range(6)]
    cs = [comp(f"F{i}", "MORT_30_PN", f"{9 + i}.0", 100, name=f"Sys {i % 2} Hospital {i}")
          for i in range(6)]
    c, h = tables(hs, cs)
    rep_rows = {r.system: r.n for r in rec.system_repeat(c, h).collect()}
    assert rep_rows == {"Sys 0": 3, "Sys 1": 2}
    ctx = rec.recommend_context(c, h).collect()
    assert [(r.eligible_hospitals, r.shown, r.top_share_pct) for r in ctx] == [(6, 5, 83.3)]
    spread = rec.top_spread(c, h).first()
    assert (spread.best_rate, spread.last_rate, spread.spread_pct) == (9.0, 13.0, 44.4)


def test_tie_at_rank_20(tables):
    # 19 distinct rates, then three facilities tied at rank 20
    rates = [f"{8 + i * 0.1:.1f}" for i in range(19)] + ["12.0", "12.0", "12.0"]
    hs = [hosp(f"F{i:02d}", state="ST") for i in range(len(rates))]
    cs = [comp(f"F{i:02d}", m, r, 40) for i, r in enumerate(rates) for m in M[:4]]
    c, h = tables(hs, cs)
    top = rep.composite_weighted(c, h).collect()          # LIMIT form: exactly 20
    assert len(top) == 20 and top[-1].quality_rank == 20 and top[-1].facility_id == "F19"
    best = [r for r in rep.best_worst(c, h).collect() if r.category == "Top 20"]
    assert len(best) == 22                                # rank filter keeps the tie
    ranked = rep.composite_ranked(c, h).collect()
    assert [r.quality_rank for r in ranked][-3:] == [20, 20, 20]


def test_duplicate_dimension_rows(tables):
    from pyspark.sql import functions as F
    hs = [hosp("F1", state="AA"), hosp("F1", state="AA"), hosp("F2", state="AA")]
    cs = [comp(f, m, s, 50) for f, s in (("F1", "10.0"), ("F2", "12.0")) for m in M[:4]]
    c, h = tables(hs, cs)
    naive = clean_mortality(c, h).groupBy("state").agg(
        F.count_distinct("facility_id").alias("num_hospitals"),
        F.round(F.sum(F.col("score") * F.col("denominator")) / F.sum("denominator"), 2)
        .cast("double").alias("weighted_avg_mortality")).collect()
    lib = rep.state_chart(c, h, min_hospitals=1).collect()
    assert sorted(map(tuple, lib)) == sorted(map(tuple, naive))      # roll-ups unchanged
    ids = [r.facility_id for r in rep.composite_weighted(c, h).collect()]
    assert sorted(ids) == ["F1", "F1", "F2"]                          # listed per duplicate
