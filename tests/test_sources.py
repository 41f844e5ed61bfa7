import pytest
from conftest import SF001

from wardrank.sources import files
from wardrank.sources.fixture import cms_fixture

HEADER = "Facility ID,Facility Name,Address,City/Town,State,ZIP Code,Hospital Type,Hospital Ownership"
ROWS = [
    '010001,"Southeast Health, Dothan",1108 Ross St,DOTHAN,AL,36301,Acute Care Hospitals,'
    "Government - Hospital District or Authority",
    "01014F,Some Clinic,1 Main St,ANYTOWN,AL,00501,Critical Access Hospitals,",
]
REORDERED = ("Facility Name,Facility ID,Address,City/Town,State,ZIP Code,Hospital Type,"
             "Hospital Ownership")


def _write(path, header, rows):
    path.write_text("\n".join([header, *rows]) + "\n")


def test_csv_keeps_ids_and_quoted_commas(spark, tmp_path):
    d = tmp_path / "h"
    d.mkdir()
    _write(d / "part1.csv", HEADER, ROWS)
    df = files.read_hospitals_csv(spark, str(d))
    assert df.columns == ["facility_id", "facility_name", "city", "state", "hospital_type",
                          "ownership"]
    got = sorted((r.facility_id, r.facility_name, r.ownership) for r in df.collect())
    assert got == [("010001", "Southeast Health, Dothan",
                    "Government - Hospital District or Authority"),
                   ("01014F", "Some Clinic", None)]
    assert dict(df.dtypes)["facility_id"] == "string"


def test_csv_binds_by_header_name(spark, tmp_path):
    d = tmp_path / "r"
    d.mkdir()
    _write(d / "only.csv", REORDERED, ["Alpha Hospital,010001,a,B,AL,1,Acute Care Hospitals,X"])
    row = files.read_hospitals_csv(spark, str(d)).first()
    assert (row.facility_id, row.facility_name) == ("010001", "Alpha Hospital")


def test_csv_rejects_a_file_with_a_different_header(spark, tmp_path):
    d = tmp_path / "mixed"
    d.mkdir()
    _write(d / "a.csv", HEADER, ROWS)
    _write(d / "b.csv", REORDERED, ["Beta,020002,a,B,AK,1,Acute Care Hospitals,Y"])
    with pytest.raises(Exception):
        files.read_hospitals_csv(spark, str(d), header=HEADER.split(",")).collect()


def test_missing_column_is_reported(spark, tmp_path):
    d = tmp_path / "bad"
    d.mkdir()
    _write(d / "a.csv", "Facility ID,State", ["010001,AL"])
    with pytest.raises(ValueError, match="missing columns"):
        files.read_hospitals_csv(spark, str(d))


def test_tables_roundtrip_counts_preview_and_catalog(spark, tmp_path):
    c, h = cms_fixture(spark, SF001)
    root = str(tmp_path / "tables")
    files.save_tables(c, h, root)
    c2, h2 = files.load_tables(spark, root)
    counts = {r.table_name: r.row_count for r in files.table_counts(c2, h2).collect()}
    assert counts == {"hospitals": 149, "complications": 900}
    assert sorted(map(tuple, c2.select(*c.columns).collect())) == sorted(map(tuple, c.collect()))
    prev = files.preview(h2, "facility_id").collect()
    assert [r.facility_id for r in prev] == sorted(r.facility_id for r in h.collect())[:3]
    files.register_views(c2, h2, prefix="t_")
    names = {r.tableName for r in files.list_tables(spark, ["t_hospitals", "t_complications"])
             .collect()}
    assert names == {"t_hospitals", "t_complications"}
    assert files.unique_key_violations(h2, "facility_id").count() == 0
    assert files.unique_key_violations(c2, ["facility_id", "measure_id"]).count() == 0


def test_analyses_as_sql_views(spark):
    from conftest import plan_text
    from wardrank.plans import recommend as rec
    from wardrank.plans.views import register_analyses

    c, h = cms_fixture(spark, SF001)
    names = register_analyses(spark, c, h, prefix="v_")
    assert "v_recommend_all" in names and "v_hospitals" in names
    one = spark.sql("SELECT * FROM v_recommend_all "
                    "WHERE state = 'NATION_5' AND measure_id = 'MORT_30_AMI'")
    direct = rec.recommend_all(c, h).filter("state = 'NATION_5' AND measure_id = 'MORT_30_AMI'")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, direct.collect()))
    # the slice predicate sits below the window, next to the scans
    plan = plan_text(one, "extended")
    window_at = plan.rindex("Window [")
    assert "NATION_5" in plan[window_at:]
    assert spark.sql("SELECT count(*) AS n FROM v_composite_weighted").first().n == 20
    # bound parameters instead of string building
    bound = spark.sql("SELECT * FROM v_recommend_all WHERE state = :state AND measure_id = :m",
                      args={"state": "NATION_5", "m": "MORT_30_AMI"})
    assert sorted(map(tuple, bound.collect())) == sorted(map(tuple, direct.collect()))
