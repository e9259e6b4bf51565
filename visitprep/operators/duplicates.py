"""How many visits are duplicated, and why."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import diagnostics
from ..functions.names import check_choice, clean_names, col, resolve, resolve_optional

#: Causes in the order in which a type's name lists them.
CAUSES = ("visit_date_change", "pid_change", "patient_class_change")
NONE, UNKNOWN = "no_duplication", "type_unknown"


def duplicate_types() -> list[str]:
    """All types a duplicated visit can have: every set of causes, and the empty one as unknown."""
    sets = [[c for i, c in enumerate(CAUSES) if mask >> i & 1] for mask in range(1 << len(CAUSES))]
    return ["+".join(s) if s else UNKNOWN for s in sets]


def _tenths(part: str, whole: str) -> str:
    """Tenths of a percent as a whole number, halves to even; exact, so alike in any engine."""
    q, r = f"(({part}) * 1000) div ({whole})", f"(({part}) * 1000) % ({whole})"
    return f"case when ({whole}) > 0 then {q} + case when 2 * ({r}) > ({whole}) or (2 * ({r}) = ({whole}) and ({q}) % 2 = 1) then 1 else 0 end end"


def _percent(part: str, whole: str) -> Column:
    """Rounded to one digit, halves to even."""
    return F.expr(f"({_tenths(part, whole)}) / 10")


def _footer(report: DuplicateSummary | DuplicateClassification) -> str:
    return f"{report.duplicate_ids.count()} facility and visit pairs have more than one row; they are in .duplicate_ids"


@dataclass(frozen=True)
class DuplicateSummary:
    """Three lazy tables: the duplicated pairs, figures by facility, and one row of totals."""

    duplicate_ids: DataFrame
    by_facility: DataFrame
    overall: DataFrame
    facility_col: str
    visit_col: str

    def text(self) -> str:
        t = self.overall.first()
        lines = [
            "Duplicate visits",
            f"  rows in all             {t.n_total_rows}",
            f"  unique visits           {t.n_unique_visits}",
            f"  duplicated visit ids    {t.n_duplicated_visit_ids} ({t.pct_duplicated}%)",
            f"  rows beyond the first   {t.n_excess_rows}",
        ]
        if t.n_duplicated_visit_ids:
            lines += [self.by_facility.toPandas().to_string(index=False), _footer(self)]
        return "\n".join(lines)

    def show(self) -> DuplicateSummary:
        print(self.text())
        return self


@dataclass(frozen=True)
class DuplicateClassification:
    """Four lazy tables: duplicated pairs, all visits with their type, counts by facility and in all.

    The table by facility is made when it is first asked for, as its columns may take a job.
    """

    duplicate_ids: DataFrame
    visit_groups: DataFrame
    make_by_facility: Callable[[], DataFrame]
    overall: DataFrame
    facility_col: str
    visit_col: str
    has_patient_class: bool

    @functools.cached_property
    def by_facility(self) -> DataFrame:
        return self.make_by_facility()

    def text(self) -> str:
        lines = ["Duplicate visits by type"]
        if not self.has_patient_class:
            lines.append("  changes of patient class could not be looked for: there is no such column")
        for table in (self.overall, self.by_facility):
            lines.append(table.toPandas().to_string(index=False))
        lines += [_footer(self), f"{self.visit_groups.count()} facility and visit pairs in all; they are in .visit_groups"]
        return "\n".join(lines)

    def show(self) -> DuplicateClassification:
        print(self.text())
        return self


def summarize_duplicates(data: DataFrame, *, facility_col: str = "HospitalName", visit_col: str = "Visit_ID") -> DuplicateSummary:
    """Count duplicated visits.  All tables come from one count of rows for each facility and visit.

    A null visit id counts as one visit of its facility.  The share is null for an empty input.
    """
    df = clean_names(data)
    facility, visit = resolve(df, facility_col), resolve(df, visit_col)
    groups = df.groupBy(col(facility), col(visit)).agg(F.count(F.lit(1)).alias("n_rows"))
    several = F.col("n_rows") > 1
    duplicated, excess = F.count(F.when(several, 1)), F.coalesce(F.sum(F.when(several, F.col("n_rows") - 1)), F.lit(0))
    by_facility = (
        groups.groupBy(col(facility))
        .agg(F.count(F.lit(1)).alias("n_visits"), duplicated.alias("n_duplicated_visit_ids"), excess.alias("n_excess_rows"))
        .withColumn("pct_duplicated", _percent("n_duplicated_visit_ids", "n_visits"))
        .filter("n_duplicated_visit_ids > 0")
        .orderBy(F.col("n_excess_rows").desc(), col(facility).asc_nulls_last())
    )
    overall = groups.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_total_rows"), F.count(F.lit(1)).alias("n_unique_visits"), duplicated.alias("n_duplicated_visit_ids"), excess.alias("n_excess_rows")
    ).withColumn("pct_duplicated", _percent("n_duplicated_visit_ids", "n_unique_visits"))
    return DuplicateSummary(groups.filter(several).select(col(facility), col(visit)), by_facility, overall, facility, visit)


def _distinct_counts(rows: DataFrame, fields: dict[str, str | None]) -> DataFrame:
    """Rows and distinct values, without nulls, by key; a field that is not there counts as one value.

    Of a key with one row it only matters whether a value is there, so the first count carries no
    values.  Those of keys with several rows, which are few, are counted in a second step, each value
    once from each task.
    """
    named = {n: c for n, c in fields.items() if c}
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(col(c)).cast("int").alias(n) for n, c in named.items()])
    several = rows.join(sizes.filter("n_rows > 1").select("key"), "key", "left_semi")
    counted = several.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), *[F.countDistinct(col(c)).cast("int").alias(n) for n, c in named.items()])
    both = sizes.filter("n_rows = 1").unionByName(counted)
    return both.withColumns({n: F.lit(1) for n in fields if n not in named})


def classify_duplicates(data: DataFrame, *, facility_col: str = "HospitalName", visit_col: str = "Visit_ID", return_format: str = "list", verbose: bool = True, observed_types_only: bool = True) -> DuplicateClassification | DataFrame:
    """Say what changes between the rows of a visit: its date, patient id, patient class.

    Needs the columns C_BioSense_ID, Date and C_Unique_Patient_ID; without C_Patient_Class that cause
    is left out.  Distinct values are counted without nulls; values of visits with one row never travel.
    ``return_format="tibble"`` gives the table of visits only.  The table by facility has a column for
    each type found, which takes one job when that table is asked for; with ``observed_types_only=False`` it has all eight.
    """
    check_choice("return_format", return_format, ("list", "tibble"))
    df = clean_names(data)
    facility, visit = resolve(df, facility_col), resolve(df, visit_col)
    needed = {c: resolve_optional(df, c) for c in ("C_BioSense_ID", "Date", "C_Unique_Patient_ID")}
    if missing := [c for c, found in needed.items() if found is None]:
        raise ValueError(f"columns that classification needs are missing: {', '.join(missing)}")
    biosense, date, pid = needed.values()
    patient_class = resolve_optional(df, "C_Patient_Class")
    if patient_class is None:
        diagnostics.inform(verbose, "there is no c_patient_class column, so changes of patient class are not looked for")
    groups = _distinct_counts(df.select(F.struct(col(facility).alias("facility"), col(visit).alias("visit")).alias("key"), *[col(c) for c in {biosense, date, pid, patient_class} if c]), {"n_biosense_ids": biosense, "n_dates": date, "n_pid": pid, "n_patient_classes": patient_class})
    groups = groups.select(F.col("key.facility").alias(facility), F.col("key.visit").alias(visit), "n_rows", "n_biosense_ids", "n_dates", "n_pid", "n_patient_classes")
    counts = ("n_dates", "n_pid", "n_patient_classes")
    causes = F.array_join(F.array(*[F.when(F.col(n) > 1, F.lit(c)) for n, c in zip(counts, CAUSES, strict=True)]), "+")
    groups = groups.withColumn("dup_type", F.when(F.col("n_rows") == 1, NONE).when(causes == "", UNKNOWN).otherwise(causes))
    if return_format == "tibble":
        return groups
    duplicated = groups.filter(F.col("dup_type") != NONE)

    def by_facility() -> DataFrame:
        types = duplicate_types()
        if observed_types_only:
            found = {r.dup_type for r in duplicated.select("dup_type").distinct().collect()}  # eight values at most
            types = [t for t in types if t in found]
        wide = duplicated.groupBy(col(facility)).agg(*[F.count(F.when(F.col("dup_type") == t, 1)).alias(t) for t in types], F.count(F.lit(1)).alias("n_duplicated_total"))
        return wide.orderBy(F.col("n_duplicated_total").desc(), col(facility).asc_nulls_last())

    totals = duplicated.groupBy("dup_type").agg(F.count(F.lit(1)).alias("n"))
    whole = duplicated.agg(F.count(F.lit(1)).alias("whole"))
    tenths = f"({_tenths('n', 'whole')})"
    overall = totals.crossJoin(F.broadcast(whole)).select("dup_type", "n", F.expr(f"concat({tenths} div 10, '.', {tenths} % 10, '%')").alias("percent"))
    return DuplicateClassification(
        duplicated.select(col(facility), col(visit)),
        groups,
        by_facility,
        overall.orderBy(F.col("n").desc(), "dup_type"),
        facility,
        visit,
        patient_class is not None,
    )


def _matched(data: DataFrame, groups: DataFrame, facility: str, visit: str, how: str) -> DataFrame:
    """Rows joined with groups by key, nulls equal to nulls."""
    df = clean_names(data)
    right = groups.withColumnsRenamed({facility: "__facility", visit: "__visit"})
    on = col(facility).eqNullSafe(F.col("__facility")) & col(visit).eqNullSafe(F.col("__visit"))
    return df.join(right, on, how).drop("__facility", "__visit")


def only_duplicated(data: DataFrame, report: DuplicateSummary | DuplicateClassification) -> DataFrame:
    """All rows of duplicated visits."""
    return _matched(data, report.duplicate_ids, report.facility_col, report.visit_col, "left_semi")


def only_unique(data: DataFrame, report: DuplicateSummary | DuplicateClassification) -> DataFrame:
    """The rows of visits that have one row."""
    return _matched(data, report.duplicate_ids, report.facility_col, report.visit_col, "left_anti")


def label_rows(data: DataFrame, report: DuplicateClassification) -> DataFrame:
    """Every row with the figures and the type of its visit."""
    return _matched(data, report.visit_groups, report.facility_col, report.visit_col, "left")
