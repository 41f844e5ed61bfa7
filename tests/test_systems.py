"""The prefix tree of system names, and the one-pass top-k with its counts."""

import random
from collections import Counter

from conftest import comp, hosp, plan_text

from wardrank.operators.systems import systems_by_name
from wardrank.plans import recommend as rec
from wardrank.sources.schema import DEDICATION_WORDS, GENERIC_NAME_WORDS, HOSPITALS_SCHEMA


def _systems(spark, names, support=3):
    rows = [(f"F{i:04d}", n, "C", "AA", "T", "O") for i, n in enumerate(names)]
    out = systems_by_name(spark.createDataFrame(rows, HOSPITALS_SCHEMA), support).collect()
    assert [(r.facility_id, r.facility_name) for r in out] == [(r[0], r[1]) for r in rows]
    return [r.system for r in out]


def _by_hand(names, support):
    """Every prefix with a word of its own, counted in a dictionary."""
    paths = []
    for name in names:
        words = "".join(c if c.isalnum() or c in "&'" else " " for c in (name or "").upper()).split()
        own = [w not in GENERIC_NAME_WORDS + DEDICATION_WORDS and not (i and words[i - 1] in DEDICATION_WORDS)
               for i, w in enumerate(words)]
        paths.append([" ".join(words[:n]) for n in range(1, len(words) + 1) if any(own[:n])])
    count = Counter(p for path in paths for p in path)
    return [max((p for p in path if count[p] >= support), key=len, default=None) for path in paths]


def test_hospitals_of_one_system_group_and_saints_do_not(spark):
    names = ["KAISER FOUNDATION HOSPITAL - FRESNO", "Kaiser Foundation Hospital, Oakland",
             "KAISER FOUNDATION HOSPITAL-SAN DIEGO", "ST MARY MEDICAL CENTER", "ST. MARY MEDICAL CENTER",
             "ST MARY MEDICAL CENTER", "ST MARY'S HOSPITAL", "MEMORIAL HOSPITAL", "MEMORIAL HOSPITAL", "MEMORIAL HOSPITAL",
             "MERCY HOSPITAL A", "MERCY HOSPITAL B", None, "", " - "]
    assert _systems(spark, names) == ["KAISER FOUNDATION HOSPITAL"] * 3 + [None] * 12
    assert _systems(spark, names, support=2)[10:12] == ["MERCY HOSPITAL"] * 2


def test_systems_equal_a_dictionary_of_prefixes(spark):
    rng = random.Random(4)
    words = ["Mercy", "St.", "Saint", "Mary", "Hospital", "Medical", "Center", "Banner", "of", "&", "North", "Ümit", "B'nai"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randrange(6))) for _ in range(400)] + [None]
    for support in (1, 2, 3, 20):
        assert _systems(spark, names, support) == _by_hand(names, support)


def test_repeats_by_name(tables):
    names = ["Banner North", "Banner South", "Banner East", "St Mary Hospital", "St Mary Hospital"]
    hs = [hosp(f"F{i}", state="TX", name=n) for i, n in enumerate(names)]
    cs = [comp(f"F{i}", "MORT_30_PN", f"{9 + i}.0", 100, name=n) for i, n in enumerate(names)]
    out = rec.system_repeat_by_name(*tables(hs, cs)).collect()
    assert [tuple(r) for r in out] == [("TX", "MORT_30_PN", "BANNER", 3)]


def _reliability(c, h, k=5, min_patients=25):
    return [tuple(r) for r in rec.recommend_reliability(c, h, k, min_patients).collect()]


def test_one_pass_equals_two(tables):
    """Ties, several rows of a facility in a slice, facilities without an
    eligible row, a dimension row twice, facilities of no dimension row."""
    rng = random.Random(9)
    hs = [hosp(f"F{i:03d}", state=f"S{i % 3}") for i in range(60)] + [hosp("F007", state="S1")]
    cs = [comp(f"F{rng.randrange(64):03d}", rng.choice(("MORT_30_PN", "MORT_30_HF")),
               rng.choice(("9.0", "9.5", "10.0", "Not Available", None, "x")), rng.choice((10, 25, 400, None)),
               mname="m") for _ in range(900)]
    c, h = tables(hs, cs)
    for k in (1, 5, 200):
        top = {r[:5] + (r.mortality_rate,): r for r in
               rec.recommend_all(c, h, k).select("state", "measure_id", "facility_id", "facility_name",
                                                 "recommendation_rank", "mortality_rate", "gap_vs_best").collect()}
        counts = {(r.state, r.measure_id): r.eligible_hospitals for r in rec.eligibility_counts(c, h).collect()}
        got = _reliability(c, h, k)
        assert Counter(r[:6] for r in got) == Counter(
            tuple(r)[:6] for r in rec.recommend_all(c, h, k).select(
                "state", "measure_id", "facility_id", "facility_name", "recommendation_rank", "mortality_rate").collect())
        assert {r[:2]: r[7] for r in got} == {s: n for s, n in counts.items() if n}
        assert all(top[r[:6]].gap_vs_best == r[8] for r in got)


def test_empty(tables):
    c, h = tables([hosp("F1")], [comp("F1", "MORT_30_PN", "9.0", 100)])
    assert _reliability(c.limit(0), h) == [] and _reliability(c, h.limit(0)) == []
    assert rec.system_repeat_by_name(c.limit(0), h.limit(0)).count() == 0


def test_reliability_reads_the_facts_once_and_combines_in_the_map_tasks(spark, tmp_path, tables):
    from wardrank.sources import files
    files.save_tables(*tables([hosp("F1")], [comp("F1", "MORT_30_PN", "9.0", 100)]), str(tmp_path))
    plan = plan_text(rec.recommend_reliability(*files.load_tables(spark, str(tmp_path))), "simple")
    assert sum("FileScan" in line and "score" in line for line in plan.splitlines()) == 1
    assert plan.count("partial_collect_top_k") == 2 and "Window" not in plan
