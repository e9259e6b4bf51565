import pytest

from visitprep.operators import assign_facility_geography, assign_treating_geography

COLS = "Region string, HospitalRegion string, ZipCode string, HospitalZip string"
ROWS = [("KY_Jefferson", "KY_Warren", "40201", "42101"), ("TN_Davidson", "KY_Warren", "37201", "42101"), ("OTHER_REGION", "KY_Kenton", None, "41011"), ("KY_UNKNOWN", "KY_Kenton", "1", None), (None, None, "2", "41011"), ("KYX_Place", "KY_Kenton", "3", "41011")]


def test_mask_and_reassignment(spark):
    df = spark.createDataFrame(ROWS, COLS)
    rows = assign_treating_geography(df, preserve_original_geographies=True).collect()
    assert [r[".out_of_state"] for r in rows] == [False, True, True, True, True, True]
    assert rows[0].region == "KY_Jefferson" and rows[0].original_region is None
    assert (rows[1].region, rows[1].original_region, rows[1].zip_code, rows[1].original_zip_code) == ("KY_Warren", "TN_Davidson", "42101", "37201")
    assert rows[3].zip_code is None and rows[4].region is None
    assert len(assign_treating_geography(df, preserve_original_geographies=True).columns) == 7


def test_partial_columns(spark):
    df = spark.createDataFrame(ROWS, COLS)
    zip_only = assign_treating_geography(df, geography=["zip"]).collect()
    assert zip_only[1].region == "TN_Davidson" and zip_only[1].zip_code == "42101"
    assert assign_treating_geography(df.drop("HospitalZip")).collect()[1].region == "KY_Warren"
    with pytest.warns(UserWarning, match="unchanged"):
        assert ".out_of_state" not in assign_treating_geography(df.drop("HospitalZip", "HospitalRegion")).columns
    with pytest.raises(ValueError, match="region"):
        assign_treating_geography(df.drop("Region"), geography=["zip"])
    with pytest.raises(ValueError, match="geography"):
        assign_treating_geography(df, geography=["county"])


def test_facility(spark):
    df = spark.createDataFrame(ROWS, COLS)
    rows = assign_facility_geography(df, preserve_original_geographies=True).collect()
    assert all(r.region == r.hospital_region and r.zip_code == r.hospital_zip and r[".facility_geography"] for r in rows)
    assert [r.original_region for r in rows] == [r[0] for r in ROWS]
    with pytest.warns(UserWarning, match="unchanged"):
        assert ".facility_geography" not in assign_facility_geography(df.drop("ZipCode", "Region")).columns
    assert assign_treating_geography(df.limit(0)).count() == 0 and assign_facility_geography(df.limit(0)).count() == 0


def test_other_site_and_plan(spark):
    df = spark.createDataFrame(ROWS, COLS)
    out = assign_treating_geography(df, site="TN")
    assert [r[".out_of_state"] for r in out.collect()] == [True, False, True, True, True, True]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_names_are_snake_case_either_way(spark):
    df = spark.createDataFrame(ROWS, COLS)
    for assign in (assign_treating_geography, assign_facility_geography):
        assert assign(df, clean_names=False).columns == assign(df).columns


def test_silence_is_for_information_only(spark, caplog):
    df = spark.createDataFrame(ROWS, COLS)
    with caplog.at_level("INFO", logger="visitprep"):
        with pytest.warns(UserWarning, match="unchanged"):
            assign_treating_geography(df.drop("HospitalZip", "HospitalRegion"), verbose=False)
        assign_treating_geography(df.drop("HospitalZip"), verbose=False)
        assert not caplog.records
        assign_treating_geography(df.drop("HospitalZip"))
    assert caplog.records
