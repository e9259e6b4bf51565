import warnings

import pytest

from visitprep.functions.diagnostics import last_diagnostics
from visitprep.operators import filter_care_setting

COLS = "HospitalName string, Hospital double, FacilityType string"
ROWS = [("General", 1001.0, "Emergency Care")] * 3 + [("North Freestanding", 1007.0, "Urgent Care"), ("North Freestanding", 1008.0, "Urgent Care"), ("Clinic ER", 1009.0, "Primary Care"), ("Inn", 1010.0, "Inpatient Practice Setting"), (None, 1011.0, "Emergency Care")]


def names(spark, **args):
    return sorted(str(r.hospital_name) for r in filter_care_setting(spark.createDataFrame(ROWS, COLS), **args).collect())


def test_default_and_types(spark):
    assert names(spark) == ["General"] * 3 + ["Inn", "None"]
    assert names(spark, keep_types=["Urgent Care"]) == ["North Freestanding"] * 2


def test_fixes(spark):
    assert names(spark, fix_facility_id_vector=["1007"]).count("North Freestanding") == 1
    assert names(spark, fix_facility_id_vector=[1007.0, 1008]).count("North Freestanding") == 2
    assert names(spark, fix_facility_type_vector=["Clinic ER", "Nowhere"]).count("Clinic ER") == 1
    with pytest.warns(UserWarning, match="Clinic ER"):
        got = names(spark, fix_facility_type_regex="ER$", diagnostics_mode="eager")
    # A row without a name cannot be judged by a pattern: its type is unknown, and it goes.
    assert "Clinic ER" in got and "None" not in got


def test_pattern_leaves_corrected_names_alone(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = names(spark, fix_facility_id_vector=[1007], fix_facility_type_regex="North")
    assert got.count("North Freestanding") == 1


def test_dry_run(spark):
    df = spark.createDataFrame(ROWS, COLS)
    with pytest.warns(UserWarning, match="Nowhere"):
        rows = filter_care_setting(df, dry_run=True, fix_facility_type_vector=["Clinic ER", "Nowhere"]).collect()
    assert rows[0].n_visits == 3
    clinic = next(r for r in rows if r.facility == "Clinic ER")
    assert (clinic.original_facility_type, clinic.corrected_facility_type, clinic[".would_keep"]) == ("Primary Care", "Emergency Care", True)


def test_messages(spark):
    df = spark.createDataFrame(ROWS, COLS)
    with pytest.warns(UserWarning, match="no rows"):
        filter_care_setting(df, keep_types=["emergency care"], diagnostics_mode="eager")
    with pytest.raises(ValueError, match="id"):
        filter_care_setting(df.drop("Hospital"), fix_facility_id_vector=[1])
    out = filter_care_setting(df)
    out.collect()
    assert last_diagnostics("filter_care_setting") == {"n_rows": 8, "n_kept": 5}
    assert filter_care_setting(df.limit(0)).count() == 0


def test_names_are_snake_case_either_way(spark):
    df = spark.createDataFrame(ROWS, COLS)
    assert filter_care_setting(df, clean_names=False).columns == filter_care_setting(df).columns


def test_a_pattern_starts_no_job(spark):
    """What a pattern matched is known when the result was computed, and bounded."""
    df = spark.createDataFrame([(f"{n} ER", 1.0 * i, "Primary Care") for i, n in enumerate("ABCDEFGHIJKLMNOP")] + [("Plain", 99.0, "Emergency Care")], COLS)
    spark.sparkContext.setJobGroup("pattern", "building a plan")
    with pytest.warns(UserWarning, match="run's figures"):
        out = filter_care_setting(df, fix_facility_id_vector=[0, 1], fix_facility_type_vector=["C ER"], fix_facility_type_regex="ER$")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("pattern")) == 0
    assert len(out.collect()) == 17 and "__named" not in out.columns
    spark.sparkContext.setJobGroup("none", "")
    figures = last_diagnostics("filter_care_setting")
    assert (figures["n_pattern_rows"], figures["n_kept"]) == (13, 17) and 11 <= figures["n_pattern_names"] <= 15
    assert 1 <= len(figures["pattern_names"]) <= 8 and all(n.endswith(" ER") for n in figures["pattern_names"])
    assert not {"A ER", "B ER", "C ER"} & set(figures["pattern_names"])


def test_silence_is_for_information_only(spark, caplog):
    df = spark.createDataFrame(ROWS, COLS)
    with caplog.at_level("INFO", logger="visitprep"):
        with pytest.warns(UserWarning, match="no rows"):
            filter_care_setting(df, keep_types=["none"], verbose=False, diagnostics_mode="eager")
        filter_care_setting(df.drop("Hospital"), verbose=False, diagnostics_mode="eager")
        assert not caplog.records
        filter_care_setting(df.drop("Hospital"), diagnostics_mode="eager")
    assert any("no facility id column" in r.message for r in caplog.records) and any("left out" in r.message for r in caplog.records)
