"""Exact percentiles by selection: histograms narrow the range that holds an order statistic.

No task holds all values.  A histogram of each group tells which bucket has the wanted rank; the next
one looks into that bucket only.  What is left at the end is ranked value by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a histogram, and how many times the range is narrowed.
BUCKETS, ROUNDS = 4096, 1


def _reached(counts: DataFrame, order: str) -> DataFrame:
    """Of counts by group, rank and ``order`` those where the rank lies, and how many values come before."""
    so_far = F.sum("n").over(Window.partitionBy("group", "rank").orderBy(order))
    return counts.withColumn("reached", so_far).withColumn("before", F.col("before") + F.col("reached") - F.col("n")).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))


def percentiles(df: DataFrame, value: str, points: dict[str, float], group: str | None = None, *, buckets: int = BUCKETS, rounds: int = ROUNDS) -> DataFrame:
    """One row for each value of ``group`` (nulls are one), or one in all, with a column for each of ``points``.

    Linearly interpolated, as Spark's ``percentile``; values that are null are left out.  Infinite values
    count as largest.  Without values there is no row.
    """
    key = F.struct(F.col("`" + group.replace("`", "``") + "`").alias("g")) if group else F.struct(F.lit(0).alias("g"))
    values = df.select(key.alias("group"), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    infinite = F.lit(float("inf"))
    sizes = values.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.min("v").alias("low"), F.max(F.when(F.col("v") < infinite, F.col("v"))).alias("top"))
    place = {name: (F.col("size") - 1) * F.lit(float(p)) for name, p in points.items()}
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)]))
    wanted = sizes.select("group", "size", F.explode(ranks).alias("rank"), "low", infinite.alias("high"), "top", F.lit(0).cast("long").alias("before"))

    def near(wanted: DataFrame) -> DataFrame:
        # Without groups, two ranks for each point at most.
        pairs = values.join(wanted, "group") if group else values.crossJoin(F.broadcast(wanted.drop("group")))
        return pairs.filter((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))

    for _ in range(rounds):
        # Each step of the formula keeps the order of values, whatever it rounds.
        bucket = F.when(F.col("v") == infinite, buckets).otherwise(F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("low"), F.col("top") - F.col("low")), F.lit(0.0)) * (buckets - 1)))
        counts = near(wanted).groupBy("group", "size", "rank", "before", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        wanted = _reached(counts, "bucket").select("group", "size", "rank", "low", "high", F.col("high").alias("top"), "before")
    found = _reached(near(wanted).groupBy("group", "size", "rank", "before", "v").agg(F.count(F.lit(1)).alias("n")), "v")
    at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("v")))
    ends = found.groupBy("group", "size").agg(*[at(f(p).cast("long")).alias(f"{name} {end}") for name, p in place.items() for end, f in (("low", F.floor), ("high", F.ceil))])

    def between(name: str) -> F.Column:
        low, high = F.col(f"`{name} low`"), F.col(f"`{name} high`")
        return F.when(low == high, low).otherwise((F.ceil(place[name]) - place[name]) * low + (place[name] - F.floor(place[name])) * high).alias(name)

    return ends.select("group", *[between(name) for name in points])
