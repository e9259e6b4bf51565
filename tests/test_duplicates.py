import itertools

import pytest

from visitprep.operators import classify_duplicates, label_rows, only_duplicated, only_unique, summarize_duplicates
from visitprep.operators.duplicates import duplicate_types

COLS = "HospitalName string, Visit_ID string, C_BioSense_ID string, Date string, C_Unique_Patient_ID string, C_Patient_Class string"


def base(n=10):
    return [(f"H{i % 3}", f"V{i}", f"BS{i}", f"d{i}", f"P{i}", "E") for i in range(n)]


def thirteen():
    rows = base()
    return [*rows, (*rows[0][:2], "other", *rows[0][3:]), (*rows[1][:2], "other", "later", *rows[1][4:]), (*rows[2][:4], "someone", "E")]


def test_counts(spark):
    s = summarize_duplicates(spark.createDataFrame(thirteen(), COLS))
    t = s.overall.first()
    assert (t.n_total_rows, t.n_unique_visits, t.n_duplicated_visit_ids, t.n_excess_rows, t.pct_duplicated) == (13, 10, 3, 3, 30.0)
    assert s.duplicate_ids.count() == 3
    by = s.by_facility.collect()
    assert sum(r.n_excess_rows for r in by) == 3 and [r.n_excess_rows for r in by] == sorted((r.n_excess_rows for r in by), reverse=True)
    assert "rows in all" in s.text() and s.show() is s


def test_null_visit_and_colliding_keys(spark):
    rows = [("A B", "C"), ("A", "B C"), ("A", None), ("A", None)]
    s = summarize_duplicates(spark.createDataFrame(rows, "HospitalName string, Visit_ID string"))
    assert s.overall.first().n_unique_visits == 3 and s.overall.first().n_duplicated_visit_ids == 1


def test_empty(spark):
    empty = spark.createDataFrame([], COLS)
    t = summarize_duplicates(empty).overall.first()
    assert (t.n_total_rows, t.n_excess_rows, t.pct_duplicated) == (0, 0, None)
    c = classify_duplicates(empty)
    assert c.overall.count() == 0 and c.by_facility.columns == ["hospital_name", "n_duplicated_total"]


def test_all_types(spark):
    rows = []
    for i, (date, pid, cls) in enumerate(itertools.product((0, 1), repeat=3)):
        rows += [("H", f"V{i}", "b", "d", "p", "E"), ("H", f"V{i}", "b2", "d" + "x" * date, "p" + "x" * pid, "EI"[cls])]
    rows.append(("H", "single", "b", "d", "p", None))
    c = classify_duplicates(spark.createDataFrame(rows, COLS))
    found = {r.visit_id: r.dup_type for r in c.visit_groups.collect()}
    assert found.pop("single") == "no_duplication"
    assert set(found.values()) == set(duplicate_types()) and len(found) == 8
    wide = c.by_facility.first().asDict()
    assert wide["n_duplicated_total"] == 8 and all(wide[t] == 1 for t in duplicate_types())
    assert {r.percent for r in c.overall.collect()} == {"12.5%"}
    assert "type_unknown" in c.text() and c.show() is c


def test_known_figures_and_format(spark):
    df = spark.createDataFrame(thirteen(), COLS)
    groups = classify_duplicates(df, return_format="tibble")
    kinds = [r.dup_type for r in groups.collect()]
    assert kinds.count("no_duplication") == 7 and kinds.count("type_unknown") == 1
    without = classify_duplicates(df.drop("C_Patient_Class"))
    assert not without.has_patient_class and {r.n_patient_classes for r in without.visit_groups.collect()} == {1}
    with pytest.raises(ValueError, match="C_BioSense_ID, Date"):
        classify_duplicates(df.drop("C_BioSense_ID", "Date"))
    with pytest.raises(ValueError, match="return_format"):
        classify_duplicates(df, return_format="frame")


def test_joins(spark):
    df = spark.createDataFrame([*thirteen(), (None, None, "b", "d", "p", "E"), (None, None, "b", "d", "p", "E")], COLS)
    s = summarize_duplicates(df)
    assert only_duplicated(df, s).count() == 8 and only_unique(df, s).count() == 7
    assert label_rows(df, classify_duplicates(df)).filter("dup_type is null").count() == 0
