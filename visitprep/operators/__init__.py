"""The visit operators: each takes DataFrames and returns lazy DataFrames or a report of them."""

from . import duplicates
from .care_setting import filter_care_setting
from .dedupe import dedupe
from .duplicates import DuplicateClassification, DuplicateSummary, classify_duplicates, label_rows, only_duplicated, only_unique, summarize_duplicates
from .episodes import link_encounters
from .geography import assign_facility_geography, assign_treating_geography
from .review import review_facility_ed_visits

__all__ = [
    "DuplicateClassification",
    "DuplicateSummary",
    "assign_facility_geography",
    "assign_treating_geography",
    "classify_duplicates",
    "dedupe",
    "duplicates",
    "filter_care_setting",
    "label_rows",
    "link_encounters",
    "only_duplicated",
    "only_unique",
    "review_facility_ed_visits",
    "summarize_duplicates",
]
