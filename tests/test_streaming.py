from wardrank.streaming.landing import load_complication_drops

HEADER = ["Facility ID", "Facility Name", "State", "Measure ID", "Measure Name",
          "Compared to National", "Denominator", "Score"]


def _drop(path, rows):
    lines = [",".join(HEADER)] + [",".join(r) for r in rows]
    path.write_text("\n".join(lines) + "\n")


def test_csv_drops_are_loaded_once_and_incrementally(spark, tmp_path):
    landing, table, ckpt = tmp_path / "landing", tmp_path / "table", tmp_path / "ckpt"
    landing.mkdir()
    _drop(landing / "a.csv", [
        ("010001", "A", "AL", "MORT_30_AMI", "heart", "No Different Than the National Rate",
         "300", "12.7"),
        ("010001", "A", "AL", "MORT_30_HF", "hf", "Not Available", "Not Available",
         "Not Available"),
    ])
    q = load_complication_drops(spark, str(landing), str(table), HEADER, checkpoint=str(ckpt))
    q.awaitTermination(120)
    first = spark.read.parquet(str(table))
    assert first.count() == 2
    assert set(first.columns) == {"facility_id", "facility_name", "measure_id", "measure_name",
                                  "compared", "denominator", "score"}
    assert {r.facility_id for r in first.collect()} == {"010001"}  # leading zero kept

    _drop(landing / "b.csv", [
        ("01014F", "B", "AK", "MORT_30_PN", "pn", "Better Than the National Rate", "90", "8.0"),
    ])
    q = load_complication_drops(spark, str(landing), str(table), HEADER, checkpoint=str(ckpt))
    q.awaitTermination(120)
    rows = spark.read.parquet(str(table)).collect()
    assert sorted(r.facility_id for r in rows) == ["010001", "010001", "01014F"]
