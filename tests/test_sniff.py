"""Sniffed types, and CSV fields with line breaks."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from wardrank.sources import files
from wardrank.sources.schema import HOSPITAL_COLUMNS
from wardrank.sources.sniff import sniff_types
from wardrank.streaming.landing import load_hospital_drops

VALUES = st.one_of(st.none(), st.sampled_from([
    "0", "12", "-7", "010001", "01014F", "3.5", "-0.25", "12.", ".5", "1e3", "true", "false", "2024-02-30", "2024-13-01", "1999-12-31",
    "Not Available", "", " 1", "9" * 18, "9" * 19, "9" * 40, "1." + "0" * 37, "12.70"]))


def _plain(values, tolerance=0.0):
    """The same question in plain Python."""
    import re

    own = [v for v in values if v is not None and v not in ("Not Available", "Not Applicable")]
    whole = [v for v in own if re.fullmatch(r"[+-]?(0|[1-9]\d*)", v)]
    dec = [v for v in own if re.fullmatch(r"[+-]?(0|[1-9]\d*)\.\d+", v)]
    date = [v for v in own if re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])", v)]
    boolean = [v for v in own if v in ("true", "false")]
    before = max([len(v.lstrip("+-").split(".")[0]) for v in whole + dec], default=0)
    after = max([len(v.split(".")[1]) for v in dec], default=0)

    def holds(n):
        return bool(own) and len(own) - n <= len(own) * tolerance

    if holds(len(boolean)):
        kind, fit = "boolean", len(boolean)
    elif holds(len(date)):
        kind, fit = "date", len(date)
    elif holds(len(whole)) and before <= 18:
        kind, fit = "bigint", len(whole)
    elif holds(len(whole) + len(dec)) and before + after <= 38:
        kind, fit = f"decimal({before + after},{after})", len(whole) + len(dec)
    else:
        kind, fit = "string", len(own)
    return kind, len(values), values.count(None), len(values) - values.count(None) - len(own), len(own) - fit


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(VALUES, min_size=6, max_size=6), min_size=4, max_size=4), st.sampled_from([0.0, 0.2, 0.5]))
def test_sniffed_types_equal_a_plain_pass(spark, columns, tolerance):
    schema = T.StructType([T.StructField(f"c {i}", T.StringType()) for i in range(4)])
    df = spark.createDataFrame(list(zip(*columns)), schema).repartition(3)
    got = sniff_types(df, tolerance=tolerance).collect()
    assert [r.column for r in got] == schema.names
    assert [tuple(r)[1:] for r in got] == [_plain(c, tolerance) for c in columns]


def test_identifiers_stay_text(spark):
    df = spark.createDataFrame([("010001", "300", "12.7", "2024-01-31"), ("01014F", "25", "8", "1999-12-01"),
                                ("020001", "Not Available", "Not Available", None)], "id string, n string, s string, d string")
    assert [(r.type, r.n_null, r.n_sentinel) for r in sniff_types(df).collect()] == [
        ("string", 0, 0), ("bigint", 0, 1), ("decimal(3,1)", 0, 1), ("date", 1, 0)]
    assert sniff_types(df.limit(0)).count() == 4


def test_sniffing_is_one_aggregate(spark):
    from conftest import plan_text

    plan = plan_text(sniff_types(spark.createDataFrame([("1", "a")], "a string, b string")))
    assert "Python" not in plan.split("== Physical Plan ==")[1].split("\n(1)")[0] and plan.count("Exchange (") <= 2


def test_line_breaks_in_both_readers_and_the_stream(spark, tmp_path):
    name = 'St. "Mary"\nof the Lake\r\nEast'
    rows = [(f"F{i}", name if i % 2 else "Plain", "City\n", "AA", "Acute", None) for i in range(20)]
    df = spark.createDataFrame(rows, ",".join(f"{c} string" for c in HOSPITAL_COLUMNS.values())).repartition(4)
    path = str(tmp_path / "csv")
    files.write_cms_csv(df, path, HOSPITAL_COLUMNS)
    want = sorted(map(tuple, df.collect()), key=str)
    for header in (None, list(HOSPITAL_COLUMNS)):
        got = files.read_hospitals_csv(spark, path, header, line_breaks=True)
        assert sorted(map(tuple, got.collect()), key=str) == want
    query = load_hospital_drops(spark, path, str(tmp_path / "table"), list(HOSPITAL_COLUMNS), line_breaks=True)
    query.awaitTermination(120)
    back = spark.read.parquet(str(tmp_path / "table")).select(*df.columns)
    assert sorted(map(tuple, back.collect()), key=str) == want

    facts = [("F1", "A\nB", "MORT_30_AMI", "heart", "No\nDifferent", "300", "12.7")]
    c = spark.createDataFrame(facts, "facility_id string, facility_name string, measure_id string, measure_name string, "
                                     "compared string, denominator string, score string")
    files.write_cms_csv(c, str(tmp_path / "facts"), files.COMPLICATION_COLUMNS)
    assert list(map(tuple, files.read_complications_csv(spark, str(tmp_path / "facts"), line_breaks=True).collect())) == facts
