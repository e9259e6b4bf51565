"""Snake-case names and lenient column lookup, decided on the schema alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ColumnNotFound(ValueError):
    """A column argument that matches no column, or more than one."""


def snake(name: str) -> str:
    """``HospitalName`` to ``hospital_name``, ``C_BioSense_ID`` to ``c_bio_sense_id``; idempotent."""
    text = name.replace("'", "").replace('"', "").replace("%", "_percent_").replace("#", "_number_")
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
    text = re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_").lower() or "x"
    return f"x{text}" if text[0].isdigit() else text


def snake_all(names: list[str]) -> list[str]:
    """Snake-case names; a leading dot stays, and repeats get ``_2``, ``_3`` in order."""
    out: list[str] = []
    for name in names:
        clean = "." + snake(name[1:]) if name.startswith(".") else snake(name)
        count, unique = 1, clean
        while unique in out:
            count += 1
            unique = f"{clean}_{count}"
        out.append(unique)
    return out


def clean_names(df: DataFrame) -> DataFrame:
    """The frame with snake-case names, assigned by position so that near-equal names cannot clash."""
    return df.toDF(*snake_all(df.columns))


def resolve(df: DataFrame, name: str) -> str:
    """The column called ``name``: exactly, or else the only one equal to it in snake case."""
    if name in df.columns:
        return name
    wanted = snake(name)
    found = [c for c, clean in zip(df.columns, snake_all(df.columns), strict=True) if clean == wanted]
    if len(found) != 1:
        raise ColumnNotFound(f"no single column matches {name!r}, neither as written nor in snake case; the columns are {', '.join(df.columns)}")
    return found[0]


def resolve_optional(df: DataFrame, name: str) -> str | None:
    try:
        return resolve(df, name)
    except ColumnNotFound:
        return None


def col(name: str) -> Column:
    """A column by name, whatever characters (such as a leading dot) the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def check_choice(argument: str, value: str, choices: tuple[str, ...]) -> str:
    if value not in choices:
        raise ValueError(f"{argument} must be one of {', '.join(choices)}; got {value!r}")
    return value
