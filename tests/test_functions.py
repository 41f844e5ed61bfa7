from decimal import Decimal

from pyspark.sql import functions as F

from wardrank.functions.aggregates import distinct_in_domain, ratio_half_up, share_pct
from wardrank.functions.casts import count_value, reported, score_value
from wardrank.functions.labels import fixed1, hospital_label, measure_label, ownership_group


def test_score_and_count_casts(spark):
    df = spark.createDataFrame(
        [("12.7", "300"), (" 9.1 ", "24"), ("Not Available", "25"),
         ("Not Applicable", "1,234"), (None, None), ("abc", "x")], "s string, d string")
    rows = df.select(score_value("s").alias("s"), count_value("d").alias("d"),
                     reported("s").alias("r")).collect()
    assert [r.s for r in rows] == [Decimal("12.7"), Decimal("9.1"), None, None, None, None]
    assert [r.d for r in rows] == [300, 24, 25, None, None, None]
    # NOT IN keeps NULL as NULL, so a filter drops the NULL row too
    assert [r.r for r in rows] == [True, True, False, False, None, True]
    assert df.schema  # no exception under ANSI mode


def test_ratio_half_up_exact_and_zero(spark):
    df = spark.createDataFrame(
        [(Decimal("201.9"), 20), (Decimal("5.0"), 0), (Decimal("-0.5"), 2), (Decimal("1.0"), 3)],
        "n decimal(26,1), d bigint")
    out = [r.q for r in df.select(ratio_half_up("n", "d", 2).alias("q")).collect()]
    # 201.9/20 = 10.095 exactly -> 10.10 (binary floats give 10.09)
    assert out == [Decimal("10.10"), None, Decimal("-0.25"), Decimal("0.33")]


def test_ratio_half_up_huge_weights(spark):
    # total weight above 1e11: a decimal(38,13) quotient would double-round here
    d = 3 * 10**12 + 1
    n = Decimal("37035000000012.3")  # n/d = 12.345 - 1.5e-14: just below the boundary
    df = spark.createDataFrame([(n, d)], "n decimal(38,1), d bigint")
    got = df.select(ratio_half_up("n", "d", 2).alias("q")).first().q
    exact = (n / Decimal(d))
    assert exact < Decimal("12.345")
    assert got == Decimal("12.34")


def test_share_pct(spark):
    df = spark.createDataFrame([(1, 8), (1, 3), (0, 0)], "p bigint, t bigint")
    assert [r.s for r in df.select(share_pct("p", "t").alias("s")).collect()] == [12.5, 33.3, None]


def test_distinct_in_domain_matches_count_distinct(spark):
    dom = ["A", "B", "C", "D", "E"]
    rows = [(1, "A"), (1, "A"), (1, "B"), (2, "C"), (2, "D"), (2, "E"), (2, "E"), (3, "A")]
    df = spark.createDataFrame(rows, "k int, m string")
    got = df.groupBy("k").agg(distinct_in_domain("m", dom).alias("a"),
                              F.count_distinct("m").alias("b")).collect()
    assert all(r.a == r.b for r in got)



OWNERSHIP_VALUES = [
    ("Veterans Health Administration", "VA"),
    ("Government - State", "Government"),
    ("Voluntary non-profit - Other", "Non-profit"),
    ("Voluntary non-profit - Private", "Non-profit"),
    ("Voluntary non-profit - Church", "Non-profit"),
    ("Proprietary", "For-profit"),
    ("Government - Hospital District or Authority", "Government"),
    ("Government - Local", "Government"),
    ("Physician", "Government"),
    ("Tribal", "Government"),
    (None, "Government"),
    ("Voluntary NON-PROFIT - Other", "Government"),  # LIKE is case-sensitive
]


def test_ownership_group(spark):
    df = spark.createDataFrame([(o,) for o, _ in OWNERSHIP_VALUES], "o string")
    got = [r.g for r in df.select(ownership_group("o").alias("g")).collect()]
    assert got == [g for _, g in OWNERSHIP_VALUES]
    strict = [r.g for r in df.select(ownership_group("o", strict=True).alias("g")).collect()]
    assert strict[8:12] == ["Other", "Other", "Other", "Other"]
    assert strict[1] == "Government"


def test_labels(spark):
    df = spark.createDataFrame([("MORT_30_AMI", "X", "NY"), ("OTHER", "Y", None)],
                               "m string, n string, s string")
    rows = df.select(measure_label("m").alias("l"), hospital_label("n", "s").alias("h")).collect()
    assert rows[0].l == "Heart Attack" and rows[1].l is None
    assert rows[0].h == "X (NY)" and rows[1].h is None


def test_fixed1_half_up(spark):
    df = spark.createDataFrame([(Decimal("2.25"),), (Decimal("0.0"),), (Decimal("43.349"),)],
                               "x decimal(10,3)")
    assert [r.t for r in df.select(fixed1("x").alias("t")).collect()] == ["2.3", "0.0", "43.3"]


def test_histogram_rank_equals_rank(spark):
    from pyspark.sql import Window

    from wardrank.operators.ranking import histogram_rank
    vals = [3.0, 1.0, 1.0, None, 2.5, 3.0, 3.0, None, 0.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, v double")
    for desc in (False, True):
        order = F.col("v").desc_nulls_last() if desc else F.col("v").asc_nulls_last()
        want = {r.id: r.r for r in df.select("id", F.rank().over(Window.orderBy(order))
                                              .alias("r")).collect()}
        got = {r.id: r.r for r in histogram_rank(df, "v", "r", descending=desc).collect()}
        assert got == want


def test_histogram_rank_windows_no_histogram_in_one_task(spark):
    """Many distinct values: the ranks are right, and the only window over the
    whole frame runs over ranges, not over values."""
    import re

    from conftest import plan_text
    from pyspark.sql import Window

    from wardrank.operators.ranking import histogram_rank
    df = spark.range(5000).select("id", F.when(F.col("id") % 50 > 0, F.col("id") * 7919 % 3001).alias("v"))
    for desc in (False, True):
        order = F.col("v").desc_nulls_last() if desc else F.col("v").asc_nulls_last()
        want = {r.id: r.r for r in df.select("id", F.rank().over(Window.orderBy(order)).alias("r")).collect()}
        ranked = histogram_rank(df, "v", "r", descending=desc)
        assert {r.id: r.r for r in ranked.collect()} == want
        windows = re.findall(r"windowspecdefinition\((\S+)", plan_text(ranked))
        assert windows and all(w.startswith("_range#") for w in windows), windows
