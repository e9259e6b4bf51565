"""One row for each facility and visit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import diagnostics
from ..functions.names import check_choice, clean_names as cleaned, col, resolve
from ..functions.ordering import ORDER, by_order


def dedupe(data: DataFrame, *, facility_col: str = "HospitalName", visit_col: str = "Visit_ID", order_by: str | None = None, keep: str = "first", clean_names: bool = True, order_key: Sequence[str] | None = None) -> DataFrame:
    """Keep one row of each facility and visit.

    ``keep`` is "first", "last" or "most_complete" (most values that are not null or NaN, the earliest
    on a tie).  ``order_by`` sorts rows before first and last are taken, nulls last, ties in row order;
    it is ignored, with a warning, for "most_complete".  Null keys form groups like any value.  Row
    order is that of ``order_key`` or of the scan.  With ``clean_names=False`` the given names come
    back.  One shuffle; Spark drops all but a task's best row of a key before it.
    """
    check_choice("keep", keep, ("first", "last", "most_complete"))
    given = data.columns
    df = cleaned(data)
    facility, visit = resolve(df, facility_col), resolve(df, visit_col)
    sort_by = resolve(df, order_by) if order_by else None
    if sort_by and keep == "most_complete":
        diagnostics.warn("order_by is ignored with keep='most_complete', which looks at completeness only")
    names = df.columns
    df, in_order = by_order(df, order_key, last=keep == "last")
    if keep == "most_complete":
        floats = {c for c, t in df.dtypes if t in ("float", "double")}
        filled = [F.when(col(c).isNotNull() & (~F.isnan(col(c)) if c in floats else F.lit(True)), 1).otherwise(0) for c in names]
        order = [sum(filled[1:], filled[0]).desc(), *in_order]
    elif keep == "first":
        order = [*([col(sort_by).asc_nulls_last()] if sort_by else []), *in_order]
    else:
        # The exact reverse of the ascending order, so a null there wins here.
        order = [*([col(sort_by).desc_nulls_first()] if sort_by else []), *in_order]
    rank = F.row_number().over(Window.partitionBy(col(facility), col(visit)).orderBy(*order))
    out = df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank", ORDER)
    return out if clean_names else out.toDF(*given)
