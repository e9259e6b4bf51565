"""Visits of unknown or distant residence, attributed to the treating facility's place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import diagnostics
from ..functions.names import check_choice, clean_names as cleaned, col, resolve_optional

KINDS = ("region", "zip")
#: Region of residents of other places, and the suffix of a site's unknown region.
OTHER, UNKNOWN = "OTHER_REGION", "UNKNOWN"


def _columns(df: DataFrame, given: dict[str, str]) -> dict[str, str | None]:
    return {k: resolve_optional(df, v) for k, v in given.items()}


def _possible(found: dict[str, str | None], geography: Sequence[str], verbose: bool, needs_region: bool) -> list[str]:
    """The kinds of geography that the columns allow."""
    out = []
    for kind in KINDS:
        if kind not in geography:
            continue
        patient, hospital = found[kind], found[f"hospital_{kind}"]
        lacking = [n for n, c in ((kind, patient if kind == "zip" or needs_region else ""), (f"hospital {kind}", hospital)) if c is None]
        if lacking:
            diagnostics.inform(verbose, f"{kind} geography is left out: there is no {lacking[0]} column")
        else:
            out.append(kind)
    return out


def _reassigned(df: DataFrame, found: dict[str, str | None], kinds: list[str], preserve: bool, flag: str, mask: Column) -> DataFrame:
    """One projection, in which originals and new values all read the values before it."""
    new = {flag: mask}
    for kind in kinds:
        patient, hospital = found[kind], found[f"hospital_{kind}"]
        if preserve:
            new["original_region" if kind == "region" else "original_zip_code"] = F.when(mask, col(patient))
        new[patient] = F.when(mask, col(hospital)).otherwise(col(patient))
    return df.withColumns(new)


def assign_treating_geography(
    data: DataFrame,
    *,
    site: str = "KY",
    geography: Sequence[str] = KINDS,
    region_col: str = "Region",
    hospital_region_col: str = "HospitalRegion",
    zip_col: str = "ZipCode",
    hospital_zip_col: str = "HospitalZip",
    preserve_original_geographies: bool = False,
    clean_names: bool = True,
    verbose: bool = True,
    diagnostics_mode: str = "lazy",
) -> DataFrame:
    """Give visits from outside the site the region and zip code of their hospital.

    ``.out_of_state`` is true, never null, where the region is null, ``OTHER_REGION``, the site's
    unknown region, or does not start with the site and an underscore.  Originals are kept under that
    flag only.  A null at the hospital replaces the value too.  Where no geography is possible the
    data come back as they are, with a warning.
    Names come back in snake case whether ``clean_names`` is set or not; only ``dedupe`` restores them.
    """
    for kind in geography:
        check_choice("geography", kind, KINDS)
    df = cleaned(data)
    found = _columns(df, {"region": region_col, "hospital_region": hospital_region_col, "zip": zip_col, "hospital_zip": hospital_zip_col})
    if found["region"] is None:
        raise ValueError("the patient's region is needed to tell visits from outside, for zip codes too")
    kinds = _possible(found, geography, verbose, needs_region=True)
    if not kinds:
        diagnostics.warn("no geography can be assigned; the data are returned unchanged")
        return df
    region = col(found["region"])
    outside = region.isNull() | F.coalesce((region == OTHER) | (region == f"{site}_{UNKNOWN}") | ~region.startswith(F.lit(f"{site}_")), F.lit(True))
    out = _reassigned(df, found, kinds, preserve_original_geographies, ".out_of_state", outside)
    figures = {"n_rows": F.count(F.lit(1)), "n_reassigned": F.count(F.when(col(".out_of_state"), 1))}
    return diagnostics.observed(out, "assign_treating_geography", diagnostics_mode, figures, lambda f: diagnostics.inform(verbose, f"{f['n_reassigned']} of {f['n_rows']} visits get the treating facility's geography"))


def assign_facility_geography(
    data: DataFrame,
    *,
    geography: Sequence[str] = KINDS,
    region_col: str = "Region",
    hospital_region_col: str = "HospitalRegion",
    zip_col: str = "ZipCode",
    hospital_zip_col: str = "HospitalZip",
    preserve_original_geographies: bool = False,
    clean_names: bool = True,
    verbose: bool = True,
) -> DataFrame:
    """Give every visit the region and zip code of its hospital, and ``.facility_geography`` true.

    Where no geography is possible the data come back as they are, with a warning.
    Names come back in snake case whether ``clean_names`` is set or not; only ``dedupe`` restores them.
    """
    for kind in geography:
        check_choice("geography", kind, KINDS)
    df = cleaned(data)
    found = _columns(df, {"region": region_col, "hospital_region": hospital_region_col, "zip": zip_col, "hospital_zip": hospital_zip_col})
    kinds = _possible(found, geography, verbose, needs_region=True)
    if not kinds:
        diagnostics.warn("no geography can be assigned; the data are returned unchanged")
        return df
    return _reassigned(df, found, kinds, preserve_original_geographies, ".facility_geography", F.lit(True))
