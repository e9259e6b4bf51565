import random

import pytest

from visitprep.operators import dedupe

COLS = "HospitalName string, Visit_ID string, seq int, when_ string, x double"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLS)


ROWS = [("A", "1", 1, "b", None), ("A", "1", 2, None, 1.0), ("A", "1", 3, "a", 2.0), ("A", "2", 4, "c", None), ("B", None, 5, "x", 1.0), ("B", None, 6, "x", float("nan")), (None, "1", 7, None, None)]


def kept(spark, **args):
    return sorted(r.seq for r in dedupe(frame(spark, ROWS), order_key=["seq"], **args).collect())


@pytest.mark.parametrize(
    ("args", "seqs"),
    [
        ({"keep": "first"}, [1, 4, 5, 7]),
        ({"keep": "last"}, [3, 4, 6, 7]),
        ({"keep": "first", "order_by": "when_"}, [3, 4, 5, 7]),
        # The last row of the ascending order with nulls last: a null wins, ties go to the last row.
        ({"keep": "last", "order_by": "when_"}, [2, 4, 6, 7]),
        ({"keep": "most_complete"}, [3, 4, 5, 7]),
    ],
)
def test_keep(spark, args, seqs):
    assert kept(spark, **args) == seqs


def test_scan_order_without_key(spark):
    df = frame(spark, ROWS).coalesce(1)
    assert sorted(r.seq for r in dedupe(df, keep="last").collect()) == [3, 4, 6, 7]


def test_same_whatever_the_partitions(spark):
    rows = ROWS[:]
    random.Random(1).shuffle(rows)
    for n in (1, 7):
        got = dedupe(frame(spark, rows).repartition(n), order_key=["seq"], keep="first")
        assert sorted(r.seq for r in got.collect()) == [1, 4, 5, 7]
        assert dedupe(got, order_key=["seq"]).count() == got.count()


def test_names_and_arguments(spark):
    df = frame(spark, ROWS)
    assert dedupe(df).columns[:2] == ["hospital_name", "visit_id"]
    assert dedupe(df, clean_names=False).columns == df.columns
    with pytest.raises(ValueError, match="keep"):
        dedupe(df, keep="best")
    with pytest.warns(UserWarning, match="order_by"):
        dedupe(df, keep="most_complete", order_by="when_")
    with pytest.raises(ValueError, match="matches"):
        dedupe(df, visit_col="nope")
    assert dedupe(df.limit(0)).count() == 0


def test_plan_limits_before_the_shuffle(spark):
    plan = dedupe(frame(spark, ROWS), order_key=["seq"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange hashpartitioning") == 1
