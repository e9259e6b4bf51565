"""Mixing sources to target weights by weighted fair queueing.

Every document copy gets a virtual finish time: the words of its source up to and including it, in a
shuffled order, divided by the source's target.  Taking copies by virtual finish time until the total
budget is spent serves all sources in proportion to their targets.

Running sums are never computed over a whole source in one task.  A source is cut into hash buckets;
the small table of bucket sums gets prefix sums, and only the rows of one bucket are ordered together.
The global range sort works likewise: virtual time is cut into ranges, whole ranges are taken or left
by the prefix sums of their totals; the one range that holds the budget's end is cut into as many
parts again, and only the part that holds it is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words as the contract counts them.
WORD = r"[^\x20\x09-\x0D]+"
SHARE = 1.5
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 2
SEED = 20240229
#: Ranges that virtual time is cut into, and parts of the range that holds the budget's end.
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets from one row per source (``src``, ``source_size``).

    Sources by code point, null last, take the weights in turn.  ``share`` of all words is dealt by
    weight; no target passes ``max_repeats`` times its source's size, and the excess goes to the
    others by weight.  This is water filling: with the sources by cap over weight there is one level
    at which min(cap, level * weight) sums to the budget, found from two prefix sums.
    """
    order = Window.orderBy(F.col("src").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("cap", F.col("source_size") * float(max_repeats))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("src").asc_nulls_last())
    all_rows = Window.partitionBy()
    level = (
        ranked.withColumn("caps_below", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("budget", F.least(F.sum("source_size").over(all_rows) * float(share), F.sum("cap").over(all_rows)))
        .withColumn("level", (F.col("budget") - F.col("caps_below")) / F.col("weights_left"))
    )
    # The first source that stays under its cap has the level; later ones would see a lower one.
    reached = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(all_rows)
    return level.withColumn("reached", reached).select(
        *[c for c in sizes.columns if c != "source_size"], "source_size", "budget", F.when(F.col("reached").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("reached") * F.col("weight"))).alias("target")
    )


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """Each document with its size, its source's size and target, and how often the mix takes it.

    Returns the columns of ``keep`` (default: the id), then ``size``, ``source_size``, ``target``,
    ``copies`` and ``taken``.  Null and empty texts have size 0 and are taken as often as their place
    in the queue says, which adds no words.  A null source is a source of its own, last in order.
    Rows with equal ids and texts are separate documents, at neighbouring places.  A mix without any
    words takes nothing; an empty table gives no rows.  The order depends on ids, texts and ``seed``
    alone, so reruns agree.  A kept column that is called like a returned one, or kept twice, raises;
    other names are free.
    """
    kept = common.kept_columns(keep or [id_col], ("size", "source_size", "target", "copies", "taken"))
    buckets = max(1024, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(
        F.struct(*[F.col(c) for c in kept]).alias("row"),
        F.col(source_col).alias("src"),
        F.col(source_col).isNull().alias("no_src"),
        F.coalesce(F.col(source_col), F.lit("")).alias("key"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("place"),
        F.xxhash64(F.lit(seed), F.col(text_col)).alias("tie"),
    ).withColumn("bucket", F.shiftrightunsigned("place", 1) % F.lit(buckets))
    # "place" orders documents by its own bits beyond the bucket; any fixed order of buckets will do.
    # Sources are keyed by two columns without nulls, so that windows and joins share one partitioning.
    key = ["no_src", "key"]
    # Words are counted once for all sums, and once more when the rows themselves are returned.
    counted = common.written(rows.drop("row"), "sizes")
    per_bucket = counted.groupBy(*key, "bucket").agg(F.first("src").alias("src"), F.sum("size").alias("bucket_size"))
    sizes = per_bucket.groupBy(*key).agg(F.first("src").alias("src"), F.sum("bucket_size").alias("source_size"))
    goal = targets(sizes, share=share, weights=weights, max_repeats=max_repeats)
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).drop("bucket_size")
    plan = starts.drop("src").join(goal.drop("src"), key)
    own = Window.partitionBy(*key, "bucket").orderBy("place", "tie").rowsBetween(Window.unboundedPreceding, 0)

    def placed(given: DataFrame) -> DataFrame:
        """Rows with the virtual finish times of their copies."""
        finish = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: (F.col("upto") + e * F.col("source_size")) / F.col("target"))
        summed = given.withColumn("within", F.sum("size").over(own)).join(plan, [*key, "bucket"])
        return summed.withColumn("upto", F.col("before") + F.col("within")).withColumn("finish", F.when(F.col("target") > 0, finish).otherwise(F.array().cast("array<double>")))

    spot = lambda f: F.least(F.floor(f * (RANGES / 2 * RANGES)), F.lit(4 * RANGES * max_repeats * RANGES)).cast("long")
    whole = lambda part: F.floor(part / RANGES).cast("long")

    def end(totals: DataFrame, start: Column, goal_words: Column) -> DataFrame:
        """The first ``range`` whose words pass the budget, and the words before it: one row, null if none."""
        upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
        summed = totals.withColumn("total", start + F.sum("range_size").over(upto)).filter(F.col("total") > goal_words)
        return summed.agg(F.min_by(F.struct("range", (F.col("total") - F.col("range_size")).alias("spent"), "budget"), "range").alias("edge"))

    copies = placed(counted).select(F.explode("finish").alias("finish"), "size", "place", "tie", "budget").withColumn("part", spot(F.col("finish")))
    totals = copies.groupBy(whole(F.col("part")).alias("range")).agg(F.sum("size").alias("range_size"), F.max("budget").alias("budget"))
    coarse = end(totals, F.lit(0), F.col("budget")).select(F.col("edge").alias("coarse"))
    near = copies.drop("budget").join(F.broadcast(coarse), whole(F.col("part")) == F.col("coarse.range"))
    parts = near.groupBy(F.col("part").alias("range")).agg(F.sum("size").alias("range_size"), F.max("coarse.spent").alias("spent"), F.max("coarse.budget").alias("budget"))
    edge = end(parts, F.col("spent"), F.col("budget"))
    inside = near.join(F.broadcast(edge), F.col("part") == F.col("edge.range")).withColumn("spent", F.col("edge.spent") + F.sum("size").over(Window.orderBy("finish", "place", "tie").rowsBetween(Window.unboundedPreceding, 0)))
    cut = inside.filter(F.col("spent") <= F.col("edge.budget")).agg(F.max(F.struct("finish", "place", "tie")).alias("last"))
    ends = edge.crossJoin(cut)  # one row each

    def takes(finish: Column) -> Column:
        at = F.struct(finish.alias("finish"), F.col("place"), F.col("tie"))
        return F.coalesce(
            F.when(F.col("edge").isNull(), F.lit(True)).when(spot(finish) < F.col("edge.range"), F.lit(True)).when(spot(finish) == F.col("edge.range"), at <= F.col("last")),
            F.lit(False),
        )

    return (
        placed(rows).crossJoin(F.broadcast(ends))
        .withColumn("copies", F.size(F.filter("finish", takes)))
        .select("row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
    )
