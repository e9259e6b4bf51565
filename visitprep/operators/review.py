"""Facilities whose number of visits stands out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import diagnostics
from ..functions.names import check_choice, clean_names as cleaned, col, resolve, resolve_optional
from ..functions.quantiles import percentiles


def review_facility_ed_visits(
    data: DataFrame,
    *,
    facility_col: str = "HospitalName",
    facility_type_col: str = "FacilityType",
    date_col: str | None = None,
    method: str = "percentile",
    percentile_low: float = 0.05,
    percentile_high: float = 0.95,
    iqr_multiplier: float = 1.5,
    group_by_type: bool = False,
    return_format: str = "outliers_only",
    clean_names: bool = True,
    verbose: bool = True,
) -> DataFrame:
    """Count visits by facility and type and flag unusual counts.

    With ``date_col`` the figure is visits for each day on which the facility has any (infinite where
    all its dates are null).  Thresholds are exact, linearly interpolated percentiles, quartile fences
    or both (either flags), over all facilities or within types; only a strictly smaller or larger
    figure is flagged.  Thresholds come by histograms that narrow the range of a rank, so no task holds
    all facilities.
    Names come back in snake case whether ``clean_names`` is set or not; only ``dedupe`` restores them.
    """
    check_choice("method", method, ("percentile", "iqr", "both"))
    check_choice("return_format", return_format, ("outliers_only", "all"))
    df = cleaned(data)
    facility, kind = resolve(df, facility_col), resolve(df, facility_type_col)
    date = resolve_optional(df, date_col) if date_col else None
    if date_col and date is None:
        diagnostics.warn(f"there is no date column {date_col!r}; visits are counted without regard to days")
    diagnostics.inform(verbose, "low counts are to be expected for narrow definitions and small hospitals")
    if date is None:
        diagnostics.inform(verbose, "without date_col the figure is the number of visits")
    if not group_by_type:
        diagnostics.inform(verbose, "all facility types are compared together; group_by_type=True compares within types")
    counts = df.groupBy(col(facility), col(kind)).agg(F.count(F.lit(1)).alias("n_visits"), *([F.countDistinct(col(date)).alias("n_days")] if date else []))
    figure = "n_visits"
    if date:
        figure = "visits_per_day"
        counts = counts.withColumn(figure, F.when(F.col("n_days") == 0, F.lit(float("inf"))).otherwise(F.col("n_visits") / F.greatest("n_days", F.lit(1))))
    points = {}
    if method != "iqr":
        points |= {"__p_low": percentile_low, "__p_high": percentile_high}
    if method != "percentile":
        points |= {"__q1": 0.25, "__q3": 0.75}
    limits = percentiles(counts, figure, points, kind if group_by_type else None)
    counts = counts.withColumn("group", F.struct(col(kind).alias("g"))).join(limits, "group").drop("group") if group_by_type else counts.crossJoin(F.broadcast(limits.drop("group")))  # one row
    low, high = [], []
    if method != "iqr":
        low.append(F.col("__p_low"))
        high.append(F.col("__p_high"))
    if method != "percentile":
        spread = (F.col("__q3") - F.col("__q1")) * F.lit(iqr_multiplier)
        low.append(F.col("__q1") - spread)
        high.append(F.col("__q3") + spread)
    below, above = F.lit(False), F.lit(False)
    for limit in low:
        below = below | (F.col(figure) < limit)
    for limit in high:
        above = above | (F.col(figure) > limit)
    out = counts.withColumns({".outlier_low": below, ".outlier_high": above}).withColumn(".outlier_flag", col(".outlier_low") | col(".outlier_high"))
    direction = F.when(col(".outlier_low") & col(".outlier_high"), "both").when(col(".outlier_low"), "low").when(col(".outlier_high"), "high")
    out = out.withColumns({".outlier_direction": direction, ".outlier_method": F.when(col(".outlier_flag"), F.lit(method))}).drop(*points)
    ties = [F.col(figure).asc_nulls_last(), col(facility).asc_nulls_last(), col(kind).asc_nulls_last()]
    if return_format == "outliers_only":
        return out.filter(col(".outlier_flag")).orderBy(col(".outlier_direction").desc_nulls_last(), *ties)
    return out.orderBy(col(".outlier_flag").desc_nulls_last(), *ties)
