"""CMS-shaped test tables derived from the TPC-H-style test data.

Recipe (see FIXTURES.md §2): every customer is a facility; ``orders ⋈
lineitem`` grouped per (customer, order priority) gives the volume ``n`` and
the returned lines ``r`` that drive a facility's score, denominator and
comparison class for five mortality measures plus one non-mortality measure.
Integer arithmetic only, so Spark and the DuckDB oracle agree exactly.

The Spark build is shaped for large inputs:

* ``lineitem`` is pre-aggregated per order before it meets ``orders`` (map-side
  partial aggregation; the shuffle carries one row per order, not per line);
* the per-customer cells are one conditional aggregation keyed by customer
  (partial aggregation absorbs a customer that owns a large share of orders),
  so there is no join on (customer, priority) and no union of two aggregates;
* the six measure rows per customer come from ``explode`` of a literal array,
  not a cross join;
* ``nation`` (25 rows by definition of the schema) is joined without a hint;
  Spark broadcasts it from its size estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import NOT_AVAILABLE, SENTINELS, WORSE, BETTER, NO_DIFFERENT

# Fixed values of the fixture recipe (FIXTURES.md §2).
# (measure_id, measure_name, order priority that feeds it; None = all)
FIXTURE_MEASURES = (
    ("MORT_30_AMI", "Death rate for heart attack patients", "1-URGENT"),
    ("MORT_30_HF", "Death rate for heart failure patients", "2-HIGH"),
    ("MORT_30_PN", "Death rate for pneumonia patients", "3-MEDIUM"),
    ("MORT_30_STK", "Death rate for stroke patients", "4-NOT SPECIFIED"),
    ("MORT_30_COPD", "Death rate for COPD patients", "5-LOW"),
    ("COMP_OTHER", "Other complication (must be filtered out by the IN list)", None),
)
SEGMENT_OWNERSHIP = (
    ("AUTOMOBILE", "Proprietary"),
    ("BUILDING", "Voluntary non-profit - Private"),
    ("HOUSEHOLD", "Voluntary non-profit - Church"),
    ("FURNITURE", "Government - Local"),
    ("MACHINERY", "Veterans Health Administration"),
)
TOO_SMALL = "Number of Cases Too Small"


def _read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def _facility_id(k: Column) -> Column:
    ks = k.cast("string")
    # at least six digits, never truncated (keys above 999,999 stay unique)
    return F.concat(F.lit("F"), F.lpad(ks, F.greatest(F.lit(6), F.length(ks)), "0"))


def _ownership(k: Column, segment: Column) -> Column:
    expr = (
        F.when(k % 101 == 3, F.lit(None).cast("string"))
        .when(k % 50 == 0, "Physician")
        .when(k % 75 == 1, "Tribal")
    )
    for seg, owner in SEGMENT_OWNERSHIP:
        expr = expr.when(segment == seg, owner)
    return expr


def fixture_hospitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = _read(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    nation = _read(spark, sf_dir, "nation", "n_nationkey", "n_name")
    k = F.col("c_custkey")
    return (
        cust.filter(k % 211 != 7)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            _facility_id(k).alias("facility_id"),
            F.concat(F.lit("System "), (k % 40).cast("string"), F.lit(" Hospital "),
                     k.cast("string")).alias("facility_name"),
            F.concat(F.col("n_name"), F.lit(" "), (k % 7).cast("string")).alias("city"),
            F.when((F.col("n_nationkey") >= 20) & (k % 8 != 0), "NATION_POOL")
            .otherwise(F.col("n_name")).alias("state"),
            F.when(k % 10 < 7, "Acute Care Hospitals")
            .otherwise("Critical Access Hospitals").alias("hospital_type"),
            _ownership(k, F.col("c_mktsegment")).alias("ownership"),
        )
    )


def _customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer: lines and returned lines per priority + overall."""
    lines = (
        _read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag")
        .groupBy("l_orderkey")
        .agg(F.count(F.lit(1)).alias("lines"),
             F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("returned"))
    )
    orders = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    aggs = []
    for i, (_, _, prio) in enumerate(FIXTURE_MEASURES):
        if prio is None:
            aggs += [F.sum("lines").alias(f"n{i}"), F.sum("returned").alias(f"r{i}")]
        else:
            hit = F.col("o_orderpriority") == prio
            aggs += [F.sum(F.when(hit, F.col("lines"))).alias(f"n{i}"),
                     F.sum(F.when(hit, F.col("returned"))).alias(f"r{i}")]
    return joined.groupBy("o_custkey").agg(*aggs)


def fixture_complications(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = _read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    cells = _customer_cells(spark, sf_dir)
    grid = F.array(*[
        F.struct(F.lit(mid).alias("measure_id"), F.lit(name).alias("measure_name"),
                 F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r"))
        for i, (mid, name, _) in enumerate(FIXTURE_MEASURES)
    ])
    k = F.col("c_custkey")
    rows = (
        cust.join(cells, k == F.col("o_custkey"), "left")
        .select(k, _ownership(k, F.col("c_mktsegment")).alias("own"),
                F.explode(grid).alias("m"))
        .select("c_custkey", "own", "m.*")
    )
    n = F.col("n")
    tenths_sql = "60 + (r * 180) div (n + 2)"  # integer division
    tenths = F.expr(tenths_sql)
    den = n * 5 + k % 7
    va_stroke = (F.col("measure_id") == "MORT_30_STK") & F.col("own").like("%Veterans%")
    na_code = k % 97 == 5
    few = n.isNull() | (n < 3)
    score = (
        F.when(na_code, SENTINELS[1])
        .when(few | va_stroke, SENTINELS[0])
        .otherwise(F.concat(F.expr(f"({tenths_sql}) div 10").cast("string"),
                            F.lit("."), (tenths % 10).cast("string")))
    )
    denominator = (
        F.when(na_code, SENTINELS[1])
        .when(few | (k % 89 == 4), SENTINELS[0])
        .otherwise(den.cast("string"))
    )
    compared = (
        F.when(na_code, F.lit(None).cast("string"))
        .when(n.isNull() | va_stroke, NOT_AVAILABLE)
        .when(n < 3, TOO_SMALL)
        .when((den >= 40) & (tenths >= 155), WORSE)
        .when((den >= 40) & (tenths <= 90), BETTER)
        .otherwise(NO_DIFFERENT)
    )
    return rows.select(
        _facility_id(k).alias("facility_id"),
        F.concat(F.lit("System "), (k % 40).cast("string"), F.lit(" Hospital "),
                 k.cast("string")).alias("facility_name"),
        "measure_id", "measure_name",
        compared.alias("compared"),
        denominator.alias("denominator"),
        score.alias("score"),
    )


def cms_fixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(complications, hospitals) derived from the test tables in ``sf_dir``."""
    return fixture_complications(spark, sf_dir), fixture_hospitals(spark, sf_dir)


# ---------------------------------------------------------------------------
# The same recipe as DuckDB SQL: CTEs named ``hospitals`` and ``complications``
# over the pre-registered views customer, nation, orders, lineitem.
# ---------------------------------------------------------------------------
def _sql_ownership(k: str, seg: str) -> str:
    arms = " ".join(f"WHEN {seg} = '{s}' THEN '{o}'" for s, o in SEGMENT_OWNERSHIP)
    return (f"CASE WHEN {k} % 101 = 3 THEN NULL WHEN {k} % 50 = 0 THEN 'Physician' "
            f"WHEN {k} % 75 = 1 THEN 'Tribal' {arms} END")


def _sql_facility_id(k: str) -> str:
    return f"'F' || lpad(CAST({k} AS VARCHAR), CAST(greatest(6, length(CAST({k} AS VARCHAR))) AS INTEGER), '0')"


def _sql_facility_name(k: str) -> str:
    return f"'System ' || CAST({k} % 40 AS VARCHAR) || ' Hospital ' || CAST({k} AS VARCHAR)"


def fixture_sql_ctes() -> str:
    """``WITH``-less CTE list defining ``hospitals`` and ``complications``."""
    sums = []
    for i, (_, _, prio) in enumerate(FIXTURE_MEASURES):
        if prio is None:
            sums.append(f"sum(lines) AS n{i}, sum(returned) AS r{i}")
        else:
            sums.append(
                f"sum(CASE WHEN o_orderpriority = '{prio}' THEN lines END) AS n{i}, "
                f"sum(CASE WHEN o_orderpriority = '{prio}' THEN returned END) AS r{i}")
    slots = ", ".join(
        f"{{'slot': {i}, 'measure_id': '{mid}', 'measure_name': '{name}'}}"
        for i, (mid, name, _) in enumerate(FIXTURE_MEASURES))
    pick_n = " ".join(f"WHEN {i} THEN x.n{i}" for i in range(len(FIXTURE_MEASURES)))
    pick_r = " ".join(f"WHEN {i} THEN x.r{i}" for i in range(len(FIXTURE_MEASURES)))
    return f"""
fx_lines AS (
    SELECT l_orderkey, count(*) AS lines,
           count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS returned
    FROM lineitem GROUP BY l_orderkey
),
fx_cells AS (
    SELECT o_custkey, {", ".join(sums)}
    FROM orders JOIN fx_lines ON o_orderkey = l_orderkey
    GROUP BY o_custkey
),
fx_rows AS (
    SELECT c_custkey, c_mktsegment, UNNEST([{slots}]) AS m FROM customer
),
fx_grid AS (
    SELECT c.c_custkey AS k, {_sql_ownership("c.c_custkey", "c.c_mktsegment")} AS own,
           c.m.measure_id AS measure_id, c.m.measure_name AS measure_name,
           CASE c.m.slot {pick_n} END AS n,
           CASE c.m.slot {pick_r} END AS r
    FROM fx_rows c
    LEFT JOIN fx_cells x ON x.o_custkey = c.c_custkey
),
fx_vals AS (
    SELECT *, 60 + (r * 180) // (n + 2) AS tenths, n * 5 + k % 7 AS den,
           (measure_id = 'MORT_30_STK' AND own LIKE '%Veterans%') AS va_stroke
    FROM fx_grid
),
complications AS (
    SELECT {_sql_facility_id("k")} AS facility_id,
           {_sql_facility_name("k")} AS facility_name,
           measure_id, measure_name,
           CASE WHEN k % 97 = 5 THEN NULL
                WHEN n IS NULL OR va_stroke THEN '{NOT_AVAILABLE}'
                WHEN n < 3 THEN '{TOO_SMALL}'
                WHEN den >= 40 AND tenths >= 155 THEN '{WORSE}'
                WHEN den >= 40 AND tenths <= 90 THEN '{BETTER}'
                ELSE '{NO_DIFFERENT}' END AS compared,
           CASE WHEN k % 97 = 5 THEN '{SENTINELS[1]}'
                WHEN n IS NULL OR n < 3 OR k % 89 = 4 THEN '{SENTINELS[0]}'
                ELSE CAST(den AS VARCHAR) END AS denominator,
           CASE WHEN k % 97 = 5 THEN '{SENTINELS[1]}'
                WHEN n IS NULL OR n < 3 OR va_stroke THEN '{SENTINELS[0]}'
                ELSE CAST(tenths // 10 AS VARCHAR) || '.' || CAST(tenths % 10 AS VARCHAR)
           END AS score
    FROM fx_vals
),
hospitals AS (
    SELECT {_sql_facility_id("c.c_custkey")} AS facility_id,
           {_sql_facility_name("c.c_custkey")} AS facility_name,
           n.n_name || ' ' || CAST(c.c_custkey % 7 AS VARCHAR) AS city,
           CASE WHEN n.n_nationkey >= 20 AND c.c_custkey % 8 <> 0 THEN 'NATION_POOL'
                ELSE n.n_name END AS state,
           CASE WHEN c.c_custkey % 10 < 7 THEN 'Acute Care Hospitals'
                ELSE 'Critical Access Hospitals' END AS hospital_type,
           {_sql_ownership("c.c_custkey", "c.c_mktsegment")} AS ownership
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
    WHERE c.c_custkey % 211 <> 7
)"""
