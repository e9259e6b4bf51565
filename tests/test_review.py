import itertools

import pytest

from visitprep.operators import review_facility_ed_visits as review

COLS = "HospitalName string, FacilityType string, Date string"


def frame(spark, counts, kind="Emergency Care"):
    return spark.createDataFrame([(f"H{i}", kind, f"d{k % 4}") for i, n in enumerate(counts) for k in range(n)], COLS)


def test_low_count_by_fences(spark):
    rows = review(frame(spark, [20, 20, 20, 20, 1]), method="iqr").collect()
    assert [(r.hospital_name, r[".outlier_direction"], r[".outlier_method"]) for r in rows] == [("H4", "low", "iqr")]


def test_equal_counts_are_never_flagged(spark):
    for method in ("percentile", "iqr", "both"):
        assert review(frame(spark, [7] * 6), method=method).count() == 0


@pytest.mark.parametrize(("method", "by_type", "date"), list(itertools.product(("percentile", "iqr", "both"), (False, True), (None, "Date"))))
def test_grid(spark, method, by_type, date):
    df = frame(spark, [30, 31, 29, 90, 2]).union(frame(spark, [5, 6, 5, 60], "Urgent Care"))
    rows = review(df, method=method, group_by_type=by_type, date_col=date, return_format="all").collect()
    assert len(rows) == 9 and all(r[".outlier_flag"] == (r[".outlier_low"] or r[".outlier_high"]) for r in rows)
    assert all((r[".outlier_direction"] is not None) == r[".outlier_flag"] for r in rows)
    assert ("visits_per_day" in rows[0]) == (date is not None)
    flags = [r[".outlier_flag"] for r in rows]
    assert flags == sorted(flags, reverse=True)


def test_days(spark):
    df = spark.createDataFrame([("A", "x", None), ("A", "x", None), ("B", "x", "d1"), ("B", "x", "d1")], COLS)
    got = {r.hospital_name: (r.n_days, r.visits_per_day) for r in review(df, date_col="Date", return_format="all").collect()}
    assert got == {"A": (0, float("inf")), "B": (1, 2.0)}
    with pytest.warns(UserWarning, match="no date column"):
        assert "n_days" not in review(df, date_col="Day").columns


def test_arguments(spark):
    with pytest.raises(ValueError, match="method"):
        review(frame(spark, [1]), method="sd")
    assert review(frame(spark, []), return_format="all").count() == 0


def test_names_are_snake_case_either_way(spark):
    df = frame(spark, [20, 20, 20, 20, 1])
    assert review(df, method="iqr", clean_names=False).columns == review(df, method="iqr").columns


def test_silence_is_for_information_only(spark, caplog):
    df = frame(spark, [20, 20, 1])
    with caplog.at_level("INFO", logger="visitprep"):
        with pytest.warns(UserWarning, match="no date column"):
            review(df, date_col="Day", verbose=False)
        assert not caplog.records
        review(df)
    assert len(caplog.records) == 3


def test_inform_and_warn(caplog):
    from visitprep.functions import diagnostics

    with caplog.at_level("INFO", logger="visitprep"):
        diagnostics.inform(False, "unsaid")
        diagnostics.inform(True, "said")
        with pytest.warns(UserWarning, match="always"):
            diagnostics.warn("always")
    assert [r.message for r in caplog.records] == ["said"]
