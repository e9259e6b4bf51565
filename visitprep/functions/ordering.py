"""The order of rows, which Spark does not keep.

Where "first" and "last" mean the order of arrival, an ``order_key`` of columns states it and makes
results independent of partitioning.  Without one the order of the scan is taken, by an id attached
before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import col, resolve

ORDER = "__order"


def with_order(df: DataFrame, order_key: Sequence[str] | None) -> DataFrame:
    """The frame with the hidden column ``ORDER``; nulls of a key column come last."""
    if order_key:
        parts = [part for c in order_key for part in (col(resolve(df, c)).isNull(), col(resolve(df, c)))]
        return df.withColumn(ORDER, F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]))
    return df.withColumn(ORDER, F.struct(F.monotonically_increasing_id().alias("k0")))


def by_order(df: DataFrame, order_key: Sequence[str] | None, last: bool = False) -> tuple[DataFrame, list[Column]]:
    """A frame and what to sort it by, in the order of ``with_order``; columns of a key are not carried twice."""
    if not order_key:
        return with_order(df, None), [F.col(ORDER).desc() if last else F.col(ORDER).asc()]
    key = [col(resolve(df, c)) for c in order_key]
    return df, [c.desc_nulls_first() if last else c.asc_nulls_last() for c in key]
