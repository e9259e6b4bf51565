"""Selected percentiles against Spark's own."""

import random

import pytest
from pyspark.sql import functions as F

from visitprep.functions.quantiles import percentiles

POINTS = {"a": 0.05, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.95, "first": 0.0, "last": 1.0}


def values(kind, rng):
    n = rng.randrange(1, 60)
    if kind == "same":
        return [7.0] * n
    if kind == "infinite":
        return [float("inf")] * n + [rng.random() for _ in range(n // 2)]
    if kind == "tail":
        return [1.5 ** rng.randrange(300) for _ in range(n)]
    return [rng.choice([0.0, 1.0, 2.5, 1e-300, 3.0, rng.random() * 1e6]) for _ in range(n)]


@pytest.mark.parametrize(("buckets", "rounds"), [(4096, 1), (3, 3), (2, 0)])
def test_same_as_percentile(spark, buckets, rounds):
    rng = random.Random(buckets)
    rows = [(g, v) for g, kind in ((None, "mixed"), ("s", "same"), ("i", "infinite"), ("t", "tail"), ("m", "mixed"), ("one", "same")) for v in values(kind, rng)] + [("m", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4).cache()
    want = {r.g: [r[p] for p in POINTS] for r in df.filter("v is not null").groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in POINTS.items()]).collect()}
    got = {r.group.g: [r[p] for p in POINTS] for r in percentiles(df, "v", POINTS, "g", buckets=buckets, rounds=rounds).collect()}
    assert {g: list(map(repr, v)) for g, v in got.items()} == {g: list(map(repr, v)) for g, v in want.items()}
    df = df.filter("v < double('infinity')")
    (all_rows,) = percentiles(df, "v", POINTS, buckets=buckets, rounds=rounds).collect()
    whole = df.agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in POINTS.items()]).first()
    assert [all_rows[p] for p in POINTS] == [whole[p] for p in POINTS]


def test_no_buffer_of_all_values(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    plan = percentiles(df, "v", POINTS)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect_list" not in plan
    assert percentiles(df.limit(0), "v", POINTS).collect() == []
