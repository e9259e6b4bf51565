"""Reconciling one field over the rows of a care episode, as expressions over an array of rows.

``values`` is an array of the field's values in row order, ``classes`` the rows' patient classes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timestamps import trimmed

STRATEGIES = ("concat", "union_delimited", "union_ccdd", "prefer_yes", "prefer_admission")
#: Classes that count as an admission.
ADMISSION = ("Inpatient", "Direct Admit", "Admitted")


def present(values: Column) -> Column:
    """Values that are neither null nor empty."""
    return F.filter(values, lambda v: v.isNotNull() & (v.cast("string") != ""))


def affirmative(value: Column) -> Column:
    """Whether a value says yes; false for a null."""
    return F.coalesce(F.lower(F.regexp_replace(value.cast("string"), r"\.0$", "")).isin("yes", "1"), F.lit(False))


def admits(patient_class: Column) -> Column:
    return F.coalesce(patient_class.isin(*ADMISSION), F.lit(False))


def _parts(texts: Column, delimiter: str) -> Column:
    """Trimmed pieces that are not empty, each once, in order of appearance."""
    pieces = F.flatten(F.transform(texts, lambda t: F.split(t, re.escape(delimiter) if len(delimiter) == 1 else rf"\Q{delimiter}\E")))
    return F.array_distinct(F.filter(F.transform(pieces, trimmed), lambda p: p != ""))


def concat(values: Column, primary: Column) -> Column:
    """The primary value, then each other one, after ``"; "``, that the text so far does not hold."""
    some = present(values)
    base = F.when(primary.isNotNull() & (primary != ""), primary).otherwise(F.get(some, F.lit(0)))
    grown = F.aggregate(some, base, lambda text, v: F.when(F.contains(text, v), text).otherwise(F.concat(text, F.lit("; "), v)))
    return F.when(F.size(some) == 0, primary).otherwise(grown)


def union_delimited(values: Column, delimiter: str) -> Column:
    """The union of delimited lists; null where no value is present."""
    some = present(values)
    return F.when(F.size(some) > 0, F.array_join(_parts(some, delimiter), delimiter))


def union_ccdd(values: Column, delimiter: str) -> Column:
    """As ``union_delimited``, on either side of the first bar; later bars and what follows are dropped."""
    some = present(values)
    half = lambda i: F.filter(F.transform(some, lambda v: F.coalesce(F.get(F.split(v, r"\|"), F.lit(i)), F.lit(""))), lambda h: h != "")
    both = [F.array_join(_parts(half(i), delimiter), delimiter) for i in (0, 1)]
    return F.when(F.size(some) > 0, F.concat(both[0], F.lit("|"), both[1]))


def prefer_yes(values: Column, primary: Column) -> Column:
    """The first affirmative value as it is written, else the primary one."""
    said = F.filter(values, affirmative)
    return F.when(F.size(said) > 0, F.get(said, F.lit(0))).otherwise(primary)


def prefer_admission(values: Column, classes: Column, primary: Column) -> Column:
    """The first present value of an admission row, else the primary one."""
    rows = F.filter(F.arrays_zip(classes.alias("c"), values.alias("v")), lambda r: admits(r["c"]) & r["v"].isNotNull() & (r["v"].cast("string") != ""))
    return F.when(F.size(rows) > 0, F.get(rows, F.lit(0))["v"]).otherwise(primary)


def merged(strategy: str, values: Column, classes: Column, primary: Column, delimiter: str) -> Column:
    if strategy == "concat":
        return concat(values, primary)
    if strategy == "union_delimited":
        return union_delimited(values, delimiter)
    if strategy == "union_ccdd":
        return union_ccdd(values, delimiter)
    if strategy == "prefer_yes":
        return prefer_yes(values, primary)
    if strategy == "prefer_admission":
        return prefer_admission(values, classes, primary)
    raise ValueError(f"unknown merge strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
