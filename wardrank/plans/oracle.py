"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each statement rebuilds the fixture from the pre-registered test views
(``customer, nation, orders, lineitem``) and answers the same question in
plain SQL.  Rates are computed in exact integers: a score ``t`` in tenths,
a weighted mean in hundredths as ``(20*sum(t*d) + sum(d)) // (2*sum(d))``
(round half up), shares in tenths as ``(2000*n + N) // (2*N)``, then cast to
DOUBLE and scaled.  DuckDB's own ROUND/decimal division are avoided on
purpose (binary rounding, no decimal division).
"""

from __future__ import annotations

from ..sources.fixture import fixture_sql_ctes
from ..sources.schema import (
    MEASURE_LABELS,
    MORTALITY_MEASURES,
    OWNERSHIP_DEFAULT,
    OWNERSHIP_GROUPS,
    OWNERSHIP_RULES,
    SENTINELS,
)
from .registry import MS, NY, TEST_VOLUME_EDGE, TX

_MEASURES = ", ".join(f"'{m}'" for m in MORTALITY_MEASURES)
_SENT = ", ".join(f"'{s}'" for s in SENTINELS)
_OG = "CASE " + " ".join(
    f"WHEN ownership {'LIKE' if kind == 'like' else '='} '{pattern}' THEN '{label}'"
    for kind, pattern, label in OWNERSHIP_RULES) + f" ELSE '{OWNERSHIP_DEFAULT}' END"
# not the library's decimal casts: doubles, scaled to integers (the fixture's
# scores have one decimal, the finer ones of ``_FINE`` up to three)
_T = "CAST(ROUND(TRY_CAST(c.score AS DOUBLE) * 10) AS BIGINT)"
_T3 = "CAST(ROUND(TRY_CAST(c.score AS DOUBLE) * 1000) AS HUGEINT)"
_D = "CAST(TRY_CAST(c.denominator AS DOUBLE) AS BIGINT)"

# clean rows: joined (mm) and unjoined (mmu)
_CLEAN_WHERE = f"""c.measure_id IN ({_MEASURES})
      AND c.score NOT IN ({_SENT}) AND c.denominator NOT IN ({_SENT})
      AND {_T} IS NOT NULL AND {_D} IS NOT NULL"""
_MM = f"""
mm AS (
    SELECT c.facility_id, c.facility_name, c.measure_id, c.measure_name, c.compared,
           {_T} AS t, {_D} AS d, h.state, h.city, h.hospital_type, h.ownership
    FROM complications c JOIN hospitals h ON c.facility_id = h.facility_id
    WHERE {_CLEAN_WHERE}
)"""
_MMU = f"""
mmu AS (
    SELECT c.facility_id, {_T} AS t, {_D} AS d
    FROM complications c
    WHERE {_CLEAN_WHERE}
)"""
_NAT = """
nat AS (SELECT (20 * SUM(t * d) + SUM(d)) // NULLIF(2 * SUM(d), 0) AS nh FROM mmu)"""


def _wh(t="t", d="d") -> str:
    """Weighted mean in hundredths, half up."""
    return f"(20 * SUM({t} * {d}) + SUM({d})) // NULLIF(2 * SUM({d}), 0)"


def _ah(t="t") -> str:
    """Plain mean in hundredths, half up."""
    return f"(20 * SUM({t}) + COUNT({t})) // NULLIF(2 * COUNT({t}), 0)"


def _h2(x: str) -> str:
    return f"CAST({x} AS DOUBLE) / 100"


def _t1(x: str) -> str:
    return f"CAST({x} AS DOUBLE) / 10"


def _text1(x: str) -> str:
    """Non-negative tenths -> 'i.f' text."""
    return f"CAST(({x}) // 10 AS VARCHAR) || '.' || CAST(({x}) % 10 AS VARCHAR)"


def _with(*ctes: str) -> str:
    return "WITH " + ",".join([fixture_sql_ctes(), *ctes])


def _facility(keys: str, having: int = 4) -> str:
    return f"""
fs AS (
    SELECT {keys}, COUNT(DISTINCT measure_id) AS measures_available,
           {_wh()} AS wh, {_ah()} AS ah, MIN(t) AS tmin, MAX(t) AS tmax,
           CAST(SUM(d) AS BIGINT) AS total_patients
    FROM mm GROUP BY {keys}
    HAVING COUNT(DISTINCT measure_id) >= {having}
)"""


def _group(key: str, having: str = "") -> str:
    return f"""
g AS (
    SELECT {key}, COUNT(DISTINCT facility_id) AS num_hospitals,
           SUM(t * d) AS w_num, SUM(d) AS w_den, SUM(t) AS m_num, COUNT(t) AS m_den,
           {_wh()} AS wh, {_ah()} AS ah, MIN(t) AS tmin, MAX(t) AS tmax
    FROM mm GROUP BY {key} {having}
)"""


def _recommend_rows(where: str = "TRUE") -> str:
    return f"""
e AS (SELECT * FROM mm WHERE d >= 25 AND {where}),
r AS (
    SELECT *,
           RANK() OVER (PARTITION BY state, measure_id ORDER BY t) AS recommendation_rank,
           ROW_NUMBER() OVER (PARTITION BY state, measure_id ORDER BY t, facility_id) AS rn,
           MIN(t) OVER (PARTITION BY state, measure_id) AS tb
    FROM e
),
top AS (
    SELECT *, {_t1("t")} AS mortality_rate, d AS patients_evaluated,
           {_text1("t - tb")} AS gap_vs_best,
           {_text1("(2000 * (t - tb) + tb) // NULLIF(2 * tb, 0)")} AS pct_worse_than_best
    FROM r WHERE rn <= 5
)"""


_ELIG_COUNTS = f"""
ec AS (
    SELECT h.state, c.measure_id,
           COUNT(DISTINCT c.facility_id) AS total_hospitals,
           COUNT(DISTINCT CASE WHEN c.score NOT IN ({_SENT}) AND {_T} IS NOT NULL
                                AND {_D} >= 25 THEN c.facility_id END) AS eligible_hospitals
    FROM complications c JOIN hospitals h ON c.facility_id = h.facility_id
    WHERE c.measure_id IN ({_MEASURES})
    GROUP BY h.state, c.measure_id
)"""


def _recommend(state: str, measure: str, gap: bool = False) -> str:
    cols = ("facility_name, city, mortality_rate, patients_evaluated, gap_vs_best, "
            "pct_worse_than_best, compared, recommendation_rank") if gap else (
        "facility_name, city, hospital_type, ownership, measure_name, mortality_rate, "
        "patients_evaluated, compared, recommendation_rank")
    return _with(_MM, _recommend_rows(f"state = '{state}' AND measure_id = '{measure}'")) + \
        f"\nSELECT {cols} FROM top"


def _eligible(measure: str, state: str | None = None) -> str:
    flags = f"""
flag AS (
    SELECT facility_id, MAX(CASE WHEN score NOT IN ({_SENT}) AND {_T} IS NOT NULL AND {_D} >= 25 THEN 1 ELSE 0 END) AS good
    FROM complications c WHERE measure_id = '{measure}' GROUP BY facility_id
)"""
    where = f"\nWHERE state = '{state}'" if state else ""
    return _with(flags) + f"""
SELECT state, COUNT(*) AS total_hospitals, CAST(SUM(good) AS BIGINT) AS eligible_hospitals
FROM hospitals JOIN flag USING (facility_id){where}
GROUP BY state"""


def _vs_national(key: str, having: str) -> str:
    return _with(_MM, _MMU, _NAT, _group(key, having)) + f"""
SELECT {key}, num_hospitals, {_h2("wh")} AS weighted_avg_mortality,
       {_h2("(SELECT nh FROM nat)")} AS national_weighted_avg,
       wh < (SELECT nh FROM nat) AS below_national,
       {_t1("(2000 * SUM(CASE WHEN wh < (SELECT nh FROM nat) THEN 1 ELSE 0 END) OVER ()"
            " + COUNT(*) OVER ()) // (2 * COUNT(*) OVER ())")} AS share_below_pct
FROM g"""


def _state_like(having: str, rank: str | None, limit: str = "", minmax_dec: bool = False):
    cols = f"state, num_hospitals, {_h2('wh')} AS weighted_avg_mortality"
    if rank is not None:
        cols += (f", {_t1('tmin')} AS best_hospital_score, {_t1('tmax')} AS worst_hospital_score"
                 f", RANK() OVER (ORDER BY {rank}) AS state_rank")
    sql = _with(_MM, _group("state", having)) + f"\nSELECT {cols} FROM g"
    if limit:
        sql = f"SELECT * FROM ({sql}) q ORDER BY state_rank, state LIMIT {limit}"
    return sql


def _owner(having: str, full: bool = True) -> str:
    cols = f"ownership, num_hospitals, {_h2('wh')} AS weighted_avg_mortality"
    if full:
        cols += (f", {_t1('tmin')} AS best_score, {_t1('tmax')} AS worst_score, "
                 "RANK() OVER (ORDER BY CAST(w_num AS DOUBLE) / w_den) AS quality_rank")
    return _with(_MM, _group("ownership", having)) + f"\nSELECT {cols} FROM g"


_LABEL = "CASE measure_id " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in MEASURE_LABELS.items()) + " END"
_PIVOT_COLS = ", ".join(
    f"{_h2(f'MAX(CASE WHEN og = {chr(39)}{g}{chr(39)} THEN wh END)')} AS \"{g}\""
    for g in OWNERSHIP_GROUPS)

_CLEAN_SEL = f"""facility_id, facility_name, state, ownership, measure_id, measure_name,
       {_t1("t")} AS score, d AS denominator, compared"""

# finer and larger values (``registry.with_fine_scores``), in thousandths
_FINE = f"""
fine AS (
    SELECT * REPLACE (
        CASE WHEN regexp_full_match(score, '[0-9]+[.][0-9]') THEN
            CASE right(facility_id, 2) WHEN '01' THEN '1000' || score WHEN '02' THEN '~' || score
                 ELSE score || right(facility_id, 2) END
        ELSE score END AS score,
        CASE WHEN regexp_full_match(denominator, '[0-9]+') THEN
            CASE right(facility_id, 2) WHEN '03' THEN '3000000000' ELSE denominator || '.0' END
        ELSE denominator END AS denominator)
    FROM complications
),
fu AS (
    SELECT c.*, {_T3} AS t, {_D} AS d FROM fine c
    WHERE c.measure_id IN ({_MEASURES}) AND c.score NOT IN ({_SENT})
      AND c.denominator NOT IN ({_SENT}) AND {_T3} IS NOT NULL AND {_D} IS NOT NULL
),
fm AS (SELECT fu.*, h.state, h.ownership FROM fu JOIN hospitals h ON fu.facility_id = h.facility_id),
fnat AS (SELECT (2 * SUM(t * d) + 10 * SUM(d)) // (20 * SUM(d)) AS nh FROM fu)"""


def _volume_bands(edge: int) -> str:
    return _with(_MM, _facility("facility_id")) + f"""
SELECT CASE WHEN total_patients < {edge} THEN 'small' ELSE 'large' END AS volume_band,
       COUNT(*) AS num_hospitals,
       {_h2("(2 * SUM(wh) + COUNT(wh)) // (2 * COUNT(wh))")} AS mean_weighted_mortality,
       CAST(COUNT(*) * SUM(p * y) - SUM(p) * SUM(y) AS DOUBLE)
         / CASE WHEN COUNT(*) * SUM(p * p) > SUM(p) * SUM(p) AND COUNT(*) * SUM(y * y) > SUM(y) * SUM(y)
           THEN SQRT(CAST(COUNT(*) * SUM(p * p) - SUM(p) * SUM(p) AS DOUBLE))
                * SQRT(CAST(COUNT(*) * SUM(y * y) - SUM(y) * SUM(y) AS DOUBLE)) END AS corr_volume_mortality
FROM (SELECT *, CAST(total_patients AS HUGEINT) AS p, CAST(wh AS HUGEINT) AS y FROM fs) GROUP BY 1"""


def _va_eligible(measure: str) -> str:
    return _with() + f"""
SELECT h.ownership, COUNT(DISTINCT c.facility_id) AS n
FROM complications c JOIN hospitals h ON c.facility_id = h.facility_id
WHERE c.measure_id = '{measure}' AND c.score NOT IN ({_SENT})
  AND h.ownership LIKE '%Veterans%'
GROUP BY h.ownership"""


ORACLE_SQL: dict[str, str] = {
    "rejected_rows": _with(_FINE) + f"""
SELECT measure_id, COUNT(*) AS total_rows,
       COUNT(*) FILTER (score NOT IN ({_SENT}) AND TRY_CAST(score AS DOUBLE) IS NULL) AS rejected_scores,
       COUNT(*) FILTER (denominator NOT IN ({_SENT}) AND TRY_CAST(denominator AS DOUBLE) IS NULL)
         AS rejected_denominators,
       COUNT(*) FILTER (TRY_CAST(score AS DOUBLE) IS NOT NULL AND regexp_matches(score, '[.][0-9]{{6}}[0-9]*[1-9]')) AS rounded_scores
FROM fine WHERE measure_id IN ({_MEASURES}) GROUP BY measure_id""",
    "fine_scores_clean": _with(_FINE) + """
SELECT facility_id, facility_name, state, ownership, measure_id, measure_name,
       CAST(t AS DOUBLE) / 1000 AS score, d AS denominator, compared FROM fm""",
    "fine_scores_states": _with(_FINE) + """
SELECT state, COUNT(DISTINCT facility_id) AS num_hospitals,
       CAST((2 * SUM(t * d) + 10 * SUM(d)) // (20 * SUM(d)) AS DOUBLE) / 100 AS weighted_avg_mortality,
       CAST((MIN(t) + 5) // 10 AS DOUBLE) / 100 AS best_hospital_score,
       CAST((MAX(t) + 5) // 10 AS DOUBLE) / 100 AS worst_hospital_score,
       RANK() OVER (ORDER BY CAST(SUM(t * d) AS DOUBLE) / SUM(d)) AS state_rank
FROM fm GROUP BY state HAVING COUNT(DISTINCT facility_id) >= 10""",
    "fine_scores_gap": _with(_FINE) + f"""
SELECT c.facility_id, c.facility_name, h.state, CAST({_T3} AS DOUBLE) / 1000 AS score,
       CAST((SELECT nh FROM fnat) AS DOUBLE) / 100 AS national_weighted_avg,
       CAST({_T3} - 10 * (SELECT nh FROM fnat) AS DOUBLE) / 1000 AS gap_to_national
FROM fine c JOIN hospitals h ON c.facility_id = h.facility_id
WHERE c.measure_id = 'MORT_30_AMI' AND c.compared = 'Worse Than the National Rate'""",
    "top_gap_to_national": _with(_MM, _MMU, _NAT, _facility("facility_id, facility_name, state")) + f"""
SELECT facility_id, facility_name, state, RANK() OVER (ORDER BY wh) AS quality_rank,
       {_h2("wh")} AS weighted_avg_mortality, {_h2("(SELECT nh FROM nat)")} AS national_weighted_avg,
       {_h2("wh - (SELECT nh FROM nat)")} AS gap_to_national, wh < (SELECT nh FROM nat) AS below_national
FROM fs ORDER BY quality_rank, facility_id LIMIT 20""",
    "table_roundtrip_hospitals": _with() + "\nSELECT * FROM hospitals",
    "volume_band_quality_default": _volume_bands(500),
    "va_heart_failure_eligible": _va_eligible("MORT_30_HF"),
    "table_counts": _with() + """
SELECT 'hospitals' AS table_name, COUNT(*) AS row_count FROM hospitals
UNION ALL SELECT 'complications', COUNT(*) FROM complications""",
    "preview_hospitals": _with() + "\nSELECT * FROM hospitals ORDER BY facility_id LIMIT 3",
    "preview_complications": _with() +
    "\nSELECT * FROM complications ORDER BY facility_id, measure_id LIMIT 3",
    "scan_csv": _with() + "\nSELECT * FROM hospitals",
    "scan_csv_complications": _with() + "\nSELECT * FROM complications",
    "table_roundtrip": _with() + "\nSELECT * FROM complications",
    "stream_load": _with() + "\nSELECT * FROM complications",
    "clean_mortality": _with(_MM) + f"\nSELECT {_CLEAN_SEL} FROM mm",
    "measure_catalog": _with() + """
SELECT measure_id, measure_name, COUNT(DISTINCT facility_id) AS num_hospitals
FROM complications GROUP BY measure_id, measure_name""",
    "measure_distribution": _with("""
cls AS (SELECT compared, COUNT(*) AS num_hospitals FROM complications
        WHERE measure_id = 'MORT_30_AMI' AND compared IS NOT NULL GROUP BY compared)""") + f"""
SELECT compared, num_hospitals,
       {_t1("(2000 * num_hospitals + SUM(num_hospitals) OVER ()) // (2 * SUM(num_hospitals) OVER ())")} AS pct
FROM cls""",
    "outliers": _with() + """
SELECT c.facility_id, c.facility_name, h.state, h.hospital_type, c.score, c.denominator
FROM complications c JOIN hospitals h ON c.facility_id = h.facility_id
WHERE c.measure_id = 'MORT_30_AMI' AND c.compared = 'Worse Than the National Rate'""",
    "composite_weighted": _with(_MM, _facility("facility_id, facility_name, state")) + f"""
SELECT facility_id, facility_name, state, measures_available,
       {_h2("wh")} AS weighted_avg_mortality, {_t1("tmin")} AS best_measure,
       {_t1("tmax")} AS worst_measure, total_patients,
       RANK() OVER (ORDER BY wh) AS quality_rank
FROM fs ORDER BY quality_rank, facility_id LIMIT 20""",
    "composite_ranked": _with(_MM, _facility("facility_id, facility_name, state")) + f"""
SELECT facility_id, facility_name, state, measures_available,
       {_h2("wh")} AS weighted_avg_mortality, {_t1("tmin")} AS best_measure,
       {_t1("tmax")} AS worst_measure, total_patients,
       RANK() OVER (ORDER BY wh) AS quality_rank
FROM fs""",
    "composite_simple": _with(_MM, _facility("facility_id, facility_name")) + f"""
SELECT fs.facility_id, fs.facility_name, measures_available,
       {_h2("ah")} AS avg_mortality_rate, {_t1("tmin")} AS best_measure,
       {_t1("tmax")} AS worst_measure, total_patients, h.state,
       RANK() OVER (ORDER BY ah) AS quality_rank
FROM fs JOIN hospitals h ON fs.facility_id = h.facility_id
ORDER BY quality_rank, fs.facility_id LIMIT 20""",
    "best_worst_20": _with(_MM, _facility("facility_id, facility_name, state"), """
rk AS (SELECT facility_name || ' (' || state || ')' AS hospital, wh,
              RANK() OVER (ORDER BY wh ASC) AS best_rank,
              RANK() OVER (ORDER BY wh DESC) AS worst_rank FROM fs)""") + f"""
SELECT hospital, {_h2("wh")} AS weighted_avg_mortality, 'Top 20' AS category
FROM rk WHERE best_rank <= 20
UNION ALL
SELECT hospital, {_h2("wh")} AS weighted_avg_mortality, 'Bottom 20' AS category
FROM rk WHERE worst_rank <= 20""",
    "volume_vs_quality": _with(_MM, _facility("facility_id, facility_name, ownership")) + f"""
SELECT facility_name, {_OG} AS ownership_group, {_h2("wh")} AS weighted_avg_mortality,
       total_patients, measures_available
FROM fs""",
    "volume_band_quality": _volume_bands(TEST_VOLUME_EDGE),
    "state_ranking": _state_like("HAVING COUNT(DISTINCT facility_id) >= 10",
                                 "CAST(w_num AS DOUBLE) / w_den"),
    "state_ranking_rounded": _state_like("HAVING COUNT(DISTINCT facility_id) >= 10", "wh",
                                         limit="15"),
    "state_chart": _state_like("HAVING COUNT(DISTINCT facility_id) >= 5", None),
    "small_states_excluded": _state_like("HAVING COUNT(DISTINCT facility_id) < 10", None),
    "rank_shift_simple_vs_weighted": _with(
        _MM, _group("state", "HAVING COUNT(DISTINCT facility_id) >= 10")) + f"""
SELECT state, num_hospitals, {_h2("ah")} AS simple_avg_mortality,
       {_h2("wh")} AS weighted_avg_mortality,
       RANK() OVER (ORDER BY CAST(m_num AS DOUBLE) / m_den) AS simple_rank,
       RANK() OVER (ORDER BY wh) AS weighted_rank,
       RANK() OVER (ORDER BY wh)
         - RANK() OVER (ORDER BY CAST(m_num AS DOUBLE) / m_den) AS rank_shift
FROM g""",
    "ownership_ranking": _owner("HAVING COUNT(DISTINCT facility_id) >= 40"),
    "ownership_ranking_all": _owner(""),
    "ownership_chart": _owner("HAVING COUNT(DISTINCT facility_id) >= 40", full=False),
    "small_groups_excluded": _owner("HAVING COUNT(DISTINCT facility_id) < 40", full=False),
    "national_avg": _with(_MMU, _NAT) + f"\nSELECT {_h2('nh')} AS national_weighted_avg FROM nat",
    "state_vs_national": _vs_national("state", "HAVING COUNT(DISTINCT facility_id) >= 5"),
    "ownership_vs_national": _vs_national("ownership",
                                          "HAVING COUNT(DISTINCT facility_id) >= 40"),
    "gap_to_national": _with(_MMU, _NAT) + f"""
SELECT c.facility_id, c.facility_name, h.state, {_t1(_T)} AS score,
       {_h2("(SELECT nh FROM nat)")} AS national_weighted_avg,
       {_h2(f"{_T} * 10 - (SELECT nh FROM nat)")} AS gap_to_national
FROM complications c JOIN hospitals h ON c.facility_id = h.facility_id
WHERE c.measure_id = 'MORT_30_AMI' AND c.compared = 'Worse Than the National Rate'""",
    "mortality_by_condition": _with(_MM) + f"""
SELECT measure_id, measure_name, {_OG} AS ownership_group,
       {_h2(_wh())} AS weighted_avg_mortality, COUNT(DISTINCT facility_id) AS num_hospitals
FROM mm GROUP BY 1, 2, 3""",
    "ownership_rank_by_condition": _with(_MM, f"""
cg AS (SELECT measure_id, measure_name, {_OG} AS ownership_group, {_wh()} AS wh,
              COUNT(DISTINCT facility_id) AS num_hospitals
       FROM mm GROUP BY 1, 2, 3)""") + f"""
SELECT measure_id, ownership_group, {_h2("wh")} AS weighted_avg_mortality, num_hospitals,
       RANK() OVER (PARTITION BY measure_id ORDER BY wh) AS group_rank
FROM cg""",
    "condition_pivot": _with(_MM, f"""
cg AS (SELECT measure_id, {_OG} AS og, {_wh()} AS wh FROM mm GROUP BY 1, 2)""") + f"""
SELECT {_LABEL} AS label, {_PIVOT_COLS}
FROM cg GROUP BY measure_id""",
    "va_stroke_eligible": _va_eligible("MORT_30_STK"),
    "va_stroke_classes": _with() + """
SELECT c.compared, COUNT(*) AS n
FROM complications c JOIN hospitals h ON c.facility_id = h.facility_id
WHERE c.measure_id = 'MORT_30_STK' AND h.ownership LIKE '%Veterans%'
GROUP BY c.compared""",
    "recommend_ny_ami": _recommend(NY, "MORT_30_AMI"),
    "recommend_tx_pn": _recommend(TX, "MORT_30_PN"),
    "recommend_ms_hf": _recommend(MS, "MORT_30_HF"),
    "recommend_gap": _recommend(NY, "MORT_30_AMI", gap=True),
    "recommend_gap_tx_pn": _recommend(TX, "MORT_30_PN", gap=True),
    "eligible_by_state": _eligible("MORT_30_HF"),
    "eligible_one_state": _eligible("MORT_30_HF", MS),
    "recommend_all": _with(_MM, _recommend_rows()) + """
SELECT state, measure_id, facility_id, facility_name, city, hospital_type, ownership,
       measure_name, mortality_rate, patients_evaluated, compared, recommendation_rank,
       gap_vs_best, pct_worse_than_best
FROM top""",
    "recommend_context": _with(_ELIG_COUNTS) + f"""
SELECT state, measure_id, total_hospitals, eligible_hospitals,
       LEAST(5, eligible_hospitals) AS shown,
       {_t1("(2000 * LEAST(5, eligible_hospitals) + eligible_hospitals)"
            " // NULLIF(2 * eligible_hospitals, 0)")} AS top_share_pct
FROM ec""",
    "top_spread": _with(_MM, _recommend_rows()) + f"""
SELECT state, measure_id, COUNT(*) AS n_shown, {_t1("MIN(t)")} AS best_rate,
       {_t1("MAX(t)")} AS last_rate,
       {_t1("(2000 * (MAX(t) - MIN(t)) + MIN(t)) // NULLIF(2 * MIN(t), 0)")} AS spread_pct
FROM top GROUP BY state, measure_id""",
    "system_repeat": _with(_MM, _recommend_rows()) + """
SELECT state, measure_id,
       array_to_string(list_slice(string_split(facility_name, ' '), 1, 2), ' ') AS system,
       COUNT(*) AS n
FROM top GROUP BY 1, 2, 3 HAVING COUNT(*) > 1""",
    "recommend_reliability": _with(_MM, _recommend_rows(), _ELIG_COUNTS) + f"""
SELECT top.state, top.measure_id, facility_id, facility_name, recommendation_rank,
       mortality_rate, patients_evaluated, eligible_hospitals, gap_vs_best,
       pct_worse_than_best, COALESCE(compared = '{"Better Than the National Rate"}', FALSE)
         AS certified_better
FROM top JOIN ec ON top.state = ec.state AND top.measure_id = ec.measure_id""",
}


def _sniff(table: str, columns: str, tolerance: float) -> str:
    """Types of the columns by their own patterns, one column at a time."""
    parts = []
    for at, c in enumerate(columns.split()):
        parts.append(f"""
SELECT {at} AS at, '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(*) FILTER ({c} IS NULL) AS n_null,
       COUNT(*) FILTER ({c} IN ({_SENT})) AS n_sentinel, COUNT(*) FILTER ({c} NOT IN ({_SENT})) AS v,
       COUNT(*) FILTER (regexp_full_match({c}, '[+-]?(0|[1-9][0-9]*)')) AS w,
       COUNT(*) FILTER (regexp_full_match({c}, '[+-]?(0|[1-9][0-9]*)[.][0-9]+')) AS f,
       MAX(length(split_part({c}, '.', 1))) FILTER (regexp_full_match({c}, '(0|[1-9][0-9]*)([.][0-9]+)?')) AS before,
       COALESCE(MAX(length(split_part({c}, '.', 2))) FILTER (regexp_full_match({c}, '(0|[1-9][0-9]*)[.][0-9]+')), 0) AS after
FROM {table}""")
    return f""", st AS ({" UNION ALL ".join(parts)}),
ty AS (SELECT *, v > 0 AND v - w <= v * {tolerance} AS whole, v > 0 AND v - w - f <= v * {tolerance} AS num FROM st)
SELECT column_name AS "column", CASE WHEN whole THEN 'bigint'
            WHEN num THEN 'decimal(' || (before + after) || ',' || after || ')' ELSE 'string' END AS "type",
       n_rows, n_null, n_sentinel, CASE WHEN whole THEN v - w WHEN num THEN v - w - f ELSE 0 END AS n_violations
FROM ty"""


_HOSPITAL = "facility_id facility_name city state hospital_type ownership"
_COMPLICATION = "facility_id facility_name measure_id measure_name compared denominator score"

_NO_NAME = "'HOSPITAL', 'HOSPITALS', 'MEDICAL', 'CENTER', 'CENTRE', 'HEALTH', 'HEALTHCARE', 'CARE', 'SYSTEM', 'REGIONAL', 'COMMUNITY', 'MEMORIAL', 'GENERAL', 'UNIVERSITY', 'COUNTY', 'DISTRICT', 'CITY', 'STATE', 'THE', 'OF', 'AND', '&', 'AT', 'FOR'"
_DEDICATED = "'ST', 'SAINT', 'SAINTS', 'STS'"
_SYSTEMS = f"""
nm AS (
    SELECT facility_id, state, CASE right(facility_id, 1) WHEN '1' THEN 'St. Mary Medical Center'
           WHEN '2' THEN 'Memorial Hospital - ' || state ELSE facility_name END AS facility_name
    FROM hospitals
),
wd AS (
    SELECT *, list_filter(string_split(regexp_replace(upper(facility_name), '[^A-Z0-9&'']+', ' ', 'g'), ' '),
                          lambda x: x <> '') AS w
    FROM nm
),
pf AS (
    SELECT facility_id, n, array_to_string(list_slice(w, 1, n), ' ') AS p
    FROM (SELECT facility_id, w, unnest(range(1, len(w) + 1)) AS n FROM wd)
    WHERE len(list_filter(list_slice(w, 1, n), lambda x, i: x NOT IN ({_NO_NAME}, {_DEDICATED})
                          AND (i = 1 OR w[i - 1] NOT IN ({_DEDICATED})))) > 0
),
sy AS (
    SELECT facility_id, arg_max(p, n) AS system FROM pf
    WHERE p IN (SELECT p FROM pf GROUP BY p HAVING COUNT(*) >= 3) GROUP BY facility_id
)"""

ORACLE_SQL |= {
    "hospital_systems": _with(_SYSTEMS) + """
SELECT facility_id, facility_name, system FROM nm LEFT JOIN sy USING (facility_id)""",
    "system_repeat_by_name": _with(_MM, _recommend_rows(), _SYSTEMS) + """
SELECT top.state, measure_id, sy.system, COUNT(*) AS n
FROM top JOIN sy USING (facility_id) GROUP BY 1, 2, 3 HAVING COUNT(*) > 1""",
    "table_replaced": ORACLE_SQL["table_roundtrip"],
    "scan_csv_line_breaks": _with() + """
SELECT * REPLACE (replace(facility_name, ' Hospital ', ' "Hospital"' || chr(10)) AS facility_name) FROM hospitals""",
    "sniff_hospitals": _with() + _sniff("hospitals", _HOSPITAL, 0.0),
    "sniff_complications": _with() + _sniff("complications", _COMPLICATION, 0.0),
    "sniff_fine_scores": _with(_FINE) + _sniff("fine", _COMPLICATION, 0.05),
    "measure_catalog_of_loads": ORACLE_SQL["measure_catalog"],
    "sql_recommend": ORACLE_SQL["recommend_ny_ami"],
    "sql_eligible": ORACLE_SQL["eligible_one_state"],
    "sql_eligible_by_state": ORACLE_SQL["eligible_by_state"],
    "sql_composite": ORACLE_SQL["composite_weighted"],
    "sql_distribution": ORACLE_SQL["measure_distribution"],
    "sql_outliers": ORACLE_SQL["outliers"],
}


def analysis_sql(name: str) -> str:
    """The oracle statement without the fixture CTEs, for DuckDB views named
    ``hospitals`` and ``complications`` over stored tables (bench baseline)."""
    fx = "WITH " + fixture_sql_ctes()
    return ORACLE_SQL[name].replace(fx + ",", "WITH ").replace(fx, "")
