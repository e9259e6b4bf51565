import pytest

from visitprep.functions.names import ColumnNotFound, clean_names, resolve, resolve_optional, snake, snake_all


@pytest.mark.parametrize(
    ("name", "clean"),
    [
        ("HospitalName", "hospital_name"),
        ("Visit_ID", "visit_id"),
        ("C_BioSense_ID", "c_bio_sense_id"),
        ("CCDDCategory_flat", "ccdd_category_flat"),
        ("CCDDParsed", "ccdd_parsed"),
        ("ZipCode", "zip_code"),
        ("HasBeenE", "has_been_e"),
        ("DispositionCategory", "disposition_category"),
        ("C_Visit_Date_Time", "c_visit_date_time"),
        ("C_Patient_Class_MDT_Updates", "c_patient_class_mdt_updates"),
        ("% done", "percent_done"),
        ("2nd", "x2nd"),
    ],
)
def test_snake(name, clean):
    assert snake(name) == clean
    assert snake(clean) == clean


def test_repeats_and_dots():
    assert snake_all(["Region", "region", ".OutOfState", "region"]) == ["region", "region_2", ".out_of_state", "region_3"]


def test_frame_with_near_equal_names(spark):
    df = clean_names(spark.createDataFrame([(1, 2, 3)], ["Region", "region", "A B"]))
    assert df.columns == ["region", "region_2", "a_b"]
    assert tuple(df.first()) == (1, 2, 3)


def test_resolve(spark):
    df = spark.createDataFrame([(1, 2)], ["HospitalName", "odd `name"])
    assert resolve(df, "hospital_name") == "HospitalName"
    assert resolve_optional(df, "Visit_ID") is None
    with pytest.raises(ColumnNotFound, match="HospitalName"):
        resolve(df, "Visit_ID")
