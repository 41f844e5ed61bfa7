"""Values that a narrow type, a decimal quotient or a plain CSV dialect would lose."""

import pytest
from conftest import comp, hosp
from pyspark.sql import functions as F

from wardrank.functions.casts import count_value, score_value
from wardrank.operators.clean import rejected_rows
from wardrank.plans import recommend as rec
from wardrank.plans import reports as rep
from wardrank.session import ensure_checkpoint_dir
from wardrank.sources import files
from wardrank.sources.schema import COMPLICATION_COLUMNS, HOSPITAL_COLUMNS
from wardrank.streaming.landing import load_complication_drops


def test_casts_keep_fine_and_large_values(spark):
    df = spark.createDataFrame([("0.17", "300.0"), ("12.345678", "3000000000"), ("10000.5", "300.5"),
                                ("abc", "1,234"), (None, None)], "s string, d string")
    got = [(None if r.s is None else str(r.s), r.d)
           for r in df.select(score_value("s").alias("s"), count_value("d").alias("d")).collect()]
    assert got == [("0.170000", 300), ("12.345678", 3000000000), ("10000.500000", None), (None, None), (None, None)]


def test_outliers_order_by_the_whole_score(tables):
    worse = "Worse Than the National Rate"
    c, h = tables([hosp(f"F{i}") for i in range(3)],
                  [comp("F0", "PSI_X", "0.17", 30, worse), comp("F1", "PSI_X", "12.75", 30, worse),
                   comp("F2", "PSI_X", "0.24", 30, worse), comp("F0", "MORT_30_HF", "1.0", 30)])
    assert [r.score for r in rep.outliers(c, h, measure="PSI_X").collect()] == ["12.75", "0.24", "0.17"]
    assert rep.gap_to_national(c, h, measure="PSI_X").first().score == 12.75


def test_rejected_rows_are_counted(tables):
    c, _ = tables([hosp("F0")], [comp("F0", "MORT_30_HF", "abc", 30), comp("F0", "MORT_30_HF", "9.0", "3x"),
                                 comp("F0", "MORT_30_HF", "Not Available", "Not Available"),
                                 comp("F0", "MORT_30_HF", None, None)])
    r = rejected_rows(c).first()
    assert (r.total_rows, r.rejected_scores, r.rejected_denominators) == (4, 1, 1)


def test_near_ties_equal_ratios_and_zero_weight(tables):
    hs = [hosp("A", state="A"), hosp("B", state="B"), hosp("C", state="C"), hosp("D", state="D"),
          hosp("E", state="E"), hosp("A2", state="A")]
    c, h = tables(hs, [
        comp("A", "MORT_30_HF", "10.1", 1500000), comp("A2", "MORT_30_HF", "10.0", 1500000),
        comp("B", "MORT_30_HF", "10.049999", 3000000),
        comp("C", "MORT_30_HF", "12.5", 10), comp("D", "MORT_30_HF", "12.5", 3000),
        comp("E", "MORT_30_HF", "9.0", 0)])
    got = {r.state: (r.state_rank, r.weighted_avg_mortality) for r in rep.state_ranking(c, h, 1).collect()}
    assert got == {"B": (1, 10.05), "A": (2, 10.05), "C": (3, 12.5), "D": (3, 12.5), "E": (5, None)}
    assert rep.ownership_ranking_all(c, h).count() == 1


def test_ratio_key_sees_beyond_six_decimals(spark):
    from wardrank.operators.metrics import exact_ratio_keys
    from wardrank.operators.ranking import with_rank
    df = spark.createDataFrame([("x", 301500000, 3000000), ("y", 301499998, 3000000), ("z", 1, 0)],
                               "k string, n10 long, d long").withColumn("n", (F.col("n10") / 10).cast("decimal(38,6)"))
    got = {r.k: r.r for r in with_rank(df, exact_ratio_keys("n", "d"), "r").collect()}
    assert got == {"y": 1, "x": 2, "z": 3}


def test_context_counts_only_rows_that_can_be_shown(tables):
    c, h = tables([hosp("F0"), hosp("F1")], [comp("F0", "MORT_30_HF", "abc", 30), comp("F1", "MORT_30_HF", "9.0", 30)])
    r = rec.recommend_context(c, h).first()
    assert (r.total_hospitals, r.eligible_hospitals, r.shown, r.top_share_pct) == (2, 1, 1, 100.0)
    assert rec.recommend_all(c, h).count() == 1


def test_csv_quotes_round_trip(spark, tables, tmp_path):
    names = ['ST "X" HOSP', 'ST "X" HOSP, INC', 'BACK\\']
    _, h = tables([hosp(f"F{i}", name=n) for i, n in enumerate(names)], [])
    files.write_cms_csv(h, str(tmp_path / "out"), HOSPITAL_COLUMNS)
    back = files.read_hospitals_csv(spark, str(tmp_path / "out"))
    assert sorted(r.facility_name for r in back.collect()) == sorted(names)
    (tmp_path / "in.csv").write_text("Facility ID,Facility Name,City/Town,State,Hospital Type,Hospital Ownership\n"
                                     '1,"ST ""X"" HOSP",C,AA,T,O\n2,"ST ""X"" HOSP, INC",C,AA,T,O\n3,"BACK\\",C,AA,T,O\n')
    got = files.read_hospitals_csv(spark, str(tmp_path / "in.csv")).orderBy("facility_id").collect()
    assert [r.facility_name for r in got] == names


def test_partition_values_stay_strings(spark, tables, tmp_path):
    c, h = tables([hosp("F0")], [comp("F0", "0123", "9.0", 30)])
    files.save_tables(c, h, str(tmp_path))
    back, _ = files.load_tables(spark, str(tmp_path))
    assert back.columns == c.columns
    assert [r.measure_id for r in back.collect()] == ["0123"]


def test_files_per_measure_do_not_follow_the_tasks(spark, tables, tmp_path):
    c, h = tables([hosp("F0")], [comp("F0", f"M{i % 2}", "9.0", 30) for i in range(400)])
    files.save_tables(c.repartition(40), h, str(tmp_path))
    assert all(len(list(p.glob("*.parquet"))) <= 2 for p in (tmp_path / "complications").glob("measure_id=*"))


def test_streams_into_tables_of_one_name_do_not_meet(spark, tmp_path):
    header = list(COMPLICATION_COLUMNS)
    for t in ("t1", "t2"):
        landing = tmp_path / t / "landing"
        landing.mkdir(parents=True)
        (landing / "a.csv").write_text(",".join(header) + '\n1,"A ""Q""",MORT_30_HF,hf,x,30,9.0\n')
        load_complication_drops(spark, str(landing), str(tmp_path / t / "complications"), header).awaitTermination(120)
        rows = spark.read.parquet(str(tmp_path / t / "complications")).collect()
        assert [r.facility_name for r in rows] == ['A "Q"']


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://somewhere:1"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_distinct_counts_over_a_long_domain(spark):
    from wardrank.functions.aggregates import distinct_in_domain
    domain = [f"m{i}" for i in range(150)]
    df = spark.createDataFrame([(m,) for m in domain + domain[:20]], "m string")
    assert df.agg(distinct_in_domain("m", domain).alias("n")).first().n == 150
