"""Visits in the wanted care settings, after corrections of facility types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import diagnostics
from ..functions.names import clean_names as cleaned, col, resolve, resolve_optional

#: Names that the figures of a pattern show, at most.
SHOWN = 8
KEEP = ("Emergency Care", "Inpatient Practice Setting")


def _in(column: Column, values: Sequence) -> Column:
    """Membership that is false, never null, for a null."""
    return F.coalesce(column.isin(list(values)), F.lit(False)) if values else F.lit(False)


def _as_text(df: DataFrame, name: str) -> Column:
    """Ids as text; whole numbers in floating-point columns without a fraction."""
    if dict(df.dtypes)[name] in ("float", "double"):
        return F.when(col(name) == F.floor(col(name)), col(name).cast("bigint").cast("string")).otherwise(col(name).cast("string"))
    return col(name).cast("string")


def _text(value: object) -> str:
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def filter_care_setting(
    data: DataFrame,
    *,
    facility_col: str = "HospitalName",
    facility_type_col: str = "FacilityType",
    facility_id_col: str = "Hospital",
    keep_types: Sequence[str] = KEEP,
    fix_facility_id_vector: Sequence | None = None,
    fix_facility_type_vector: Sequence[str] | None = None,
    fix_facility_type_regex: str | None = None,
    fix_to: str = "Emergency Care",
    dry_run: bool = False,
    clean_names: bool = True,
    verbose: bool = True,
    diagnostics_mode: str = "lazy",
) -> DataFrame:
    """Correct facility types by id, then by name, then by pattern; keep rows of ``keep_types``.

    The pattern applies to names that no earlier step corrected (a name counts as corrected when any
    of its ids was).  It always warns; how many visits and facilities (about) it changed, and some of
    their names, are figures of the run, shown at once with ``diagnostics_mode="eager"``.  With a pattern, a row without a facility name gets a null type and is dropped.
    ``dry_run`` returns instead the number of visits for each facility and pair of types, largest
    first, with ``.would_keep``, and warns of listed names that do not occur.
    Names come back in snake case whether ``clean_names`` is set or not; only ``dedupe`` restores them.
    """
    df = cleaned(data)
    facility, kind = resolve(df, facility_col), resolve(df, facility_type_col)
    ident = resolve_optional(df, facility_id_col)
    if ident is None and fix_facility_id_vector is not None:
        raise ValueError("fix_facility_id_vector needs the facility id column, which is not in the data")
    if ident is None:
        diagnostics.inform(verbose, "there is no facility id column; corrections by id outlast changes of names")
    original, fixed, by_name = ".original_facility_type", col(kind), F.lit(False)
    df = df.withColumn(original, col(kind))
    figures: dict[str, Column] = {}
    if ident is not None and fix_facility_id_vector is not None:
        by_id = _in(_as_text(df, ident), [_text(v) for v in fix_facility_id_vector])
        fixed = F.when(by_id, F.lit(fix_to)).otherwise(fixed)
        if fix_facility_type_regex is not None:
            # The names of the listed ids.
            names = df.filter(by_id & col(facility).isNotNull()).select(col(facility).alias("__name")).distinct().withColumn("__named", F.lit(True))
            df = df.join(F.broadcast(names), col(facility) == F.col("__name"), "left").drop("__name")
            by_name = F.coalesce(F.col("__named"), F.lit(False))
    if fix_facility_type_vector is not None:
        names = list(fix_facility_type_vector)
        if dry_run and names:
            present = {r[0] for r in df.filter(_in(col(facility), names)).select(col(facility)).distinct().collect()}  # at most the listed names
            if unmatched := [n for n in names if n not in present]:
                diagnostics.warn(f"{len(unmatched)} names of fix_facility_type_vector do not occur and have no effect: {', '.join(unmatched)}")
        fixed = F.when(_in(col(facility), names), F.lit(fix_to)).otherwise(fixed)
        by_name = by_name | _in(col(facility), names)
    if fix_facility_type_regex is not None:
        hit = ~by_name & col(facility).rlike(fix_facility_type_regex)  # null, and so is the type, without a name
        fixed = F.when(hit.isNull(), F.lit(None).cast("string")).when(hit, F.lit(fix_to)).otherwise(fixed)
        found = F.when(hit, col(facility))
        figures = {"n_pattern_rows": F.count(found), "n_pattern_names": F.approx_count_distinct(found), "pattern_names": F.array_distinct(F.array_compact(F.array(*[F.min(F.when(F.pmod(F.xxhash64(found), F.lit(SHOWN)) == i, found)) for i in range(SHOWN)])))}
        if diagnostics_mode != "eager":
            diagnostics.warn(f"facilities whose name matches fix_facility_type_regex become {fix_to!r}; the run's figures say how many and name some; listing ids or names is more lasting")
    df = df.withColumn(kind, fixed)

    def tell(figures: dict) -> None:
        if figures.get("n_pattern_rows"):
            diagnostics.warn(f"{figures['n_pattern_rows']} visits of about {figures['n_pattern_names']} facilities match fix_facility_type_regex and become {fix_to!r}, such as {', '.join(figures['pattern_names'])}; listing ids or names is more lasting")
        if figures.get("n_rows") and figures["n_kept"] < figures["n_rows"]:
            diagnostics.inform(verbose, f"{figures['n_rows'] - figures['n_kept']} visits of other facility types are left out")
        if "n_rows" in figures and not figures["n_kept"]:
            diagnostics.warn(f"no rows are left: none has a facility type of {', '.join(keep_types)} (spelling and case count)")

    if dry_run:
        if figures:
            df = diagnostics.observed(df, "filter_care_setting", diagnostics_mode, figures, tell)
        renamed = [col(facility).alias("facility"), *([col(ident).alias("facility_id")] if ident else []), col(original).alias("original_facility_type"), col(kind).alias("corrected_facility_type")]
        counts = df.groupBy(*renamed).agg(F.count(F.lit(1)).alias("n_visits"))
        return counts.withColumn(".would_keep", _in(F.col("corrected_facility_type"), keep_types)).orderBy(F.col("n_visits").desc(), F.col("facility").asc_nulls_last(), F.col("original_facility_type").asc_nulls_last())
    kept = _in(col(kind), keep_types)
    df = diagnostics.observed(df, "filter_care_setting", diagnostics_mode, {"n_rows": F.count(F.lit(1)), "n_kept": F.count(F.when(kept, 1)), **figures}, tell)
    return df.filter(kept).drop(original, "__named")
