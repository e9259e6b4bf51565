"""What keeps shuffles and work in proportion to the input."""

import datetime as dt

from pyspark.sql import functions as F

from visitprep import operators as op
from visitprep.functions.timestamps import parse_timestamp
from visitprep.sources import star


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_timestamps_match_once(spark):
    at = lambda *a: dt.datetime(2020, 1, 2, *a)
    texts = {
        "2020-01-02T03:04:05Z": at(3, 4, 5),
        " \t2020-1-2  14:05 Z": at(14, 5),
        "2020-01-02 noon": at(),
        "01/02/2020 08:30": at(8, 30),
        "2020-01-02T25:04:05": at(),
        "2020-01-02T03:04:99": at(3, 4),
        "2020-01-02T12:345:10": at(12, 34),
        "2020-13-02T03:04:05": None,
        "1|2|3|4|5|6": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_timestamp(F.col("t")).alias("at"))
    assert {r.t: r["at"] for r in df.collect()} == texts
    assert "regexp_extract" not in plan(df)


def test_classification_starts_no_job_until_asked(spark):
    df = spark.createDataFrame([("F", "1", "b", "d", "p"), ("F", "1", "b", "d", "q")], "HospitalName string, Visit_ID string, C_BioSense_ID string, Date string, C_Unique_Patient_ID string")
    spark.sparkContext.setJobGroup("classify", "")
    report = op.classify_duplicates(df, verbose=False)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("classify")
    spark.sparkContext.setJobGroup("other", "")
    assert report.by_facility.columns == ["hospital_name", "pid_change", "n_duplicated_total"]


def test_linkage_moves_records_before_their_classes(spark):
    df = spark.createDataFrame([("F", "1", 1, 1, 5), ("F", "1", 1, 0, 4)], "HospitalName string, Visit_ID string, HasBeenE int, HasBeenAdmitted int, k int")
    out = op.link_encounters(df, return_format="long", order_key=["k"], verbose=False)
    lines = plan(out).splitlines()
    opened = next(i for i, s in enumerate(lines) if "Generate" in s)
    assert any("RepartitionByExpression" in s for s in lines[opened:])  # below the explode
    assert not any("LeftAnti" in s for s in lines)  # which is pushed below the caller's joins
    assert sorted(r.patient_class for r in out.collect()) == ["Admitted", "ED", "ED"]


def test_orders_meet_customers_first():
    assert "join (orders join customer" in star.select_sql(star.COLUMNS, dialect="spark")
    assert star.FROM in star.select_sql(star.COLUMNS)


def test_deduplication_carries_no_second_order(spark):
    df = spark.createDataFrame([("F", "1", 2), ("F", "1", None), ("F", "1", 1)], "HospitalName string, Visit_ID string, k int")
    out = op.dedupe(df, keep="first", order_key=["k"])
    assert "__order" not in plan(out)
    assert [r.k for r in out.collect()] == [1]
    assert [r.k for r in op.dedupe(df, keep="last", order_key=["k"]).collect()] == [None]
