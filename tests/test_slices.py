"""Run-time reduction to a slice, SQL table functions, distinct counts of
loads, both edges of a ranking, exact correlation."""

import math
import random

import pytest
from conftest import SF001, comp, hosp, plan_text
from pyspark.sql import functions as F

from wardrank.functions.aggregates import co_moments, exact_corr
from wardrank.functions.casts import count_value, rounded_score, score_value
from wardrank.operators.distinct import distinct_partials, number_keys, roll_up
from wardrank.operators.ranking import edges
from wardrank.operators.reduce import near_keys
from wardrank.plans import recommend as rec
from wardrank.plans import reports as rep
from wardrank.plans.views import register_functions
from wardrank.sources import files
from wardrank.sources.fixture import cms_fixture


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("slices"))
    files.save_tables(*cms_fixture(spark, SF001), root)
    return files.load_tables(spark, root)


def test_near_keys_lose_none_and_pass_few(spark):
    df = spark.range(200_000).select(F.concat(F.lit("F"), "id").alias("k"), "id").unionByName(
        spark.createDataFrame([(None, -1)], "k string, id long"))
    keys = df.filter("id % 97 = 5")
    near = near_keys(df, "k", keys)
    got = {r.id for r in near.collect()}
    want = {i for i in range(200_000) if i % 97 == 5}
    assert want <= got and len(got) < 1.05 * len(want)
    crowded = near_keys(df, "k", keys, bits=1 << 10)  # a full filter lets all pass
    assert want <= {r.id for r in crowded.collect()}
    assert near_keys(df, "k", keys.limit(0)).count() == 0


def test_one_state_is_reduced_before_the_shuffle(spark, stored):
    c, h = stored
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = rec.eligible_one_state(c, h, "NATION_5")
        plan = plan_text(df)
        assert sorted(map(tuple, df.collect())) == sorted(
            tuple(r) for r in rec.eligible_by_state(c, h).collect() if r.state == "NATION_5")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    tree = plan.split("== Physical Plan ==")[1].split("\n\n")[0]
    partial = tree.index("HashAggregate", tree.rindex("Exchange", 0, tree.index("Scan parquet")))
    assert tree.index("Filter", partial) < tree.index("Scan parquet", partial)
    assert "bit_get" in plan
    ids = h.filter("state = 'NATION_5'").select("facility_id")
    passed = near_keys(c, "facility_id", ids).select("facility_id").distinct().count()
    assert ids.count() * 0.9 <= passed <= ids.count() * 1.1 + 2


def test_sql_functions_equal_the_functions(spark, stored):
    c, h = stored
    assert register_functions(spark, c, h, prefix="t_")[0] == "t_recommend"
    for state, k, least in (("NATION_5", 5, 25), ("NATION_POOL", 3, 60), ("nowhere", 5, 25)):
        df = spark.sql(f"SELECT * FROM t_recommend('{state}', 'MORT_30_AMI', {k}, {least})")
        want = rec.recommend(c, h, state, "MORT_30_AMI", k, least)
        assert df.columns == want.columns and df.dtypes == want.dtypes
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))
    plan = plan_text(spark.sql("SELECT * FROM t_recommend('NATION_5', 'MORT_30_AMI')"))
    assert "EqualTo(state,NATION_5)" in plan and "measure_id" in plan.split("PartitionFilters")[1] and "MORT_30_AMI)" in plan
    got = spark.sql("SELECT * FROM t_eligible_hospitals('MORT_30_HF', min_patients => 60)").collect()
    want = rec.eligible_by_state(c, h, "MORT_30_HF", 60).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    got = spark.sql("SELECT * FROM t_composite(7, 3)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rep.composite_weighted(c, h, 7, 3).select(*got.columns).collect()))
    # a function call joins like a table
    joined = spark.sql("SELECT s.x, r.* FROM VALUES ('NATION_5'), ('NATION_1') AS s(x), LATERAL t_eligible_hospitals('MORT_30_HF', s.x) r")
    assert {r.x for r in joined.collect()} == {"NATION_5", "NATION_1"} and all(r.x == r.state for r in joined.collect())


def test_distinct_counts_of_loads(spark):
    rng = random.Random(3)
    loads = [[(f"k{rng.randrange(90_000)}", rng.choice("ab")) for _ in range(30_000)] + [(None, "a")] for _ in range(3)]
    frames = [spark.createDataFrame(x, "k string, g string") for x in loads]
    numbers, parts = None, None
    for f in frames:
        numbers = number_keys(f, "k", numbers).cache()
        part = distinct_partials(f, numbers, "k", ["g"])
        parts = part if parts is None else parts.unionByName(part)
    n = sorted(r.n for r in numbers.collect())
    assert n == list(range(1, len({k for x in loads for k, _ in x if k}) + 1))
    got = {r.g: r.c for r in roll_up(parts, ["g"], "c").collect()}
    assert got == {g: len({k for x in loads for k, h in x if h == g and k}) for g in "ab"}


def test_catalog_of_loads(spark, stored):
    c, _ = stored
    parts = [c.filter("facility_id < 'F000100'"), c.filter("facility_id >= 'F000050'"), c.limit(0)]
    assert rep.measure_catalog_of_loads(parts).collect() == rep.measure_catalog(c).collect()


def test_edges_of_both_ends(spark):
    rng = random.Random(5)
    for k in (1, 3, 20):
        values = [rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8, 9]) for _ in range(40)]
        df = spark.createDataFrame([(v,) for v in values], "v int")
        low, high = edges(df, k, "v")
        got = sorted((r.v, r.lo, r.hi) for r in df.filter("v is not null").select(
            "v", (F.col("v") <= low).alias("lo"), (F.col("v") >= high).alias("hi")).collect())
        own = [v for v in values if v is not None]
        assert got == sorted((v, sum(x < v for x in own) < k, sum(x > v for x in own) < k) for v in own)


def test_best_worst_finishes_the_aggregate_once(spark, stored):
    c, h = stored
    df = rep.best_worst(c, h)
    plan = plan_text(df)
    assert "measure_id" not in plan and "facility_id" not in plan  # only the stored rates are read
    assert df.count() >= 40


def test_correlation_has_the_same_bits_however_it_is_split(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(10_000_000), rng.randrange(600, 2500)) for _ in range(3000)] + [(None, 5), (5, None)]
    df = spark.createDataFrame(rows, "x long, y long")
    got = {df.repartition(n).agg(*co_moments("x", "y")).select(exact_corr()).first()[0].hex() for n in (1, 7, 64)}
    assert len(got) == 1
    own = [(x, y) for x, y in rows if x is not None and y is not None]
    n, sx, sy = len(own), sum(x for x, _ in own), sum(y for _, y in own)
    cov, vx, vy = (n * sum(x * y for x, y in own) - sx * sy, n * sum(x * x for x, _ in own) - sx * sx, n * sum(y * y for _, y in own) - sy * sy)
    assert got == {(float(cov) / (math.sqrt(float(vx)) * math.sqrt(float(vy)))).hex()}
    flat = spark.createDataFrame([(1, 2), (1, 3)], "x long, y long").agg(*co_moments("x", "y")).select(exact_corr()).first()[0]
    assert flat is None


def test_values_at_the_edges_of_the_casts(spark):
    rows = ["300.0000001", "300.0", "300", "0.0000004", "1.234567", "1.2345670", "1.2345678", "~1", None, "300.5"]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    counts = [r[0] for r in df.select(count_value("v")).collect()]
    assert counts == [None, 300, 300, None, None, None, None, None, None, None]
    rounded = [bool(r[0]) for r in df.select(rounded_score("v")).collect()]
    assert rounded == [True, False, False, True, False, False, True, False, False, False]
    assert str(df.select(score_value("v")).collect()[3][0]) in ("0.000000", "0E-6")


def test_rejected_rows_count_rounded_scores(tables):
    from wardrank.operators.clean import rejected_rows

    c, _ = tables([hosp("F1")], [comp("F1", "MORT_30_AMI", "0.0000004", "300.0000001"), comp("F2", "MORT_30_AMI", "12.5", "30")])
    r = rejected_rows(c).first()
    assert (r.total_rows, r.rejected_scores, r.rejected_denominators, r.rounded_scores) == (2, 0, 1, 1)
