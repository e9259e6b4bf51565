"""Lenient timestamps and positional update lists, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import col

# Of the forms year-month-day (a T or blanks before the time) and month/day/year (blanks), either with seconds, with
# minutes or without a time.  A form has to match the start of the text; what follows is ignored, as the C
# library's strptime does.  The expression always matches, with empty groups where there is no date.
_CLOCK = r"(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?"
_FORMS = r"^[ \t\r\n]*(?:(\d{1,4})-(\d{1,2})-(\d{1,2})(?:(?:T|\s+)" + _CLOCK + r")?|(\d{1,2})/(\d{1,2})/(\d{1,4})(?:\s+" + _CLOCK + r")?)?(?s:.*)"
#: Year, month, day, hour, minute and second, from whichever form matched.
_PARTS = "$1$9|$2$7|$3$8|$4$10|$5$11|$6$12"


def trimmed(text: Column) -> Column:
    """Without blanks, tabs and line ends on either side."""
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def parse_timestamp(text: Column) -> Column:
    """A timestamp without zone from the first of seconds, minutes and date that gives a valid one, else null.

    A text is matched once, whatever its form.
    """

    parts = F.split(F.regexp_replace(text, _FORMS, _PARTS), r"\|")  # occurs often, and Spark evaluates it once
    some = [F.when(F.get(parts, F.lit(i)) != "", F.get(parts, F.lit(i))) for i in range(6)]  # casting '' would cost an exception
    year, month, day, hour, minute = (p.try_cast("int") for p in some[:5])
    none, zero = F.lit(0), F.lit(0).cast("decimal(16,6)")
    times = ((hour, minute, some[5].try_cast("decimal(16,6)")), (hour, minute, zero), (none, none, zero))
    return F.coalesce(*[F.call_function("try_make_timestamp_ntz", year, month, day, *time) for time in times])


def as_timestamp(df: DataFrame, name: str) -> Column:
    """A column as timestamp without zone: real ones pass through, dates are midnights, text is parsed."""
    kind = dict(df.dtypes)[name]
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return col(name).cast("timestamp_ntz")
    return parse_timestamp(col(name).cast("string"))


def parse_updates(updates: Column, n: Column) -> Column:
    """``{position};time;|...`` as an array of ``n`` texts; the last segment for a position counts."""
    segments = F.transform(F.split(F.coalesce(updates, F.lit("")), r"\|"), trimmed)
    pattern = r"^\{(\d+)\}\s*;\s*([^;]+)"
    found = F.filter(
        F.transform(segments, lambda s: F.struct(F.regexp_extract(s, pattern, 1).try_cast("int").alias("at"), trimmed(F.regexp_extract(s, pattern, 2)).alias("time"), s.rlike(pattern).alias("ok"))),
        lambda s: s["ok"],
    )
    at = lambda i: F.try_element_at(F.filter(found, lambda s: s["at"] == i), F.lit(-1))["time"]
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), at)).otherwise(F.array().cast("array<string>"))
