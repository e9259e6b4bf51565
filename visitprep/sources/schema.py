"""The visit table's usual columns, and a seeded table of invented visits."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TEXT, _INT = T.StringType(), T.IntegerType()
#: The 18 columns of a raw pull, in order.
VISITS = T.StructType([
    T.StructField("HospitalName", _TEXT), T.StructField("Hospital", _INT), T.StructField("FacilityType", _TEXT), T.StructField("HospitalRegion", _TEXT), T.StructField("HospitalZip", _TEXT),
    T.StructField("Visit_ID", _TEXT), T.StructField("C_BioSense_ID", _TEXT), T.StructField("C_Unique_Patient_ID", _TEXT), T.StructField("Date", T.DateType()), T.StructField("C_Visit_Date_Time", T.TimestampType()),
    T.StructField("Arrived_Date_Time", T.TimestampType()), T.StructField("HasBeenE", _INT), T.StructField("HasBeenAdmitted", _INT), T.StructField("C_Patient_Class", _TEXT), T.StructField("Region", _TEXT),
    T.StructField("ZipCode", _TEXT), T.StructField("Sex", _TEXT), T.StructField("C_Patient_Age", _INT),
])

#: Emergency departments, freestanding ones that are filed as urgent care, and other facilities.
EMERGENCY, FREESTANDING, OTHER = 6, 2, 2
BASE, ELSEWHERE = 160, 20
#: Copies added for each kind of change: none, date, patient id, date and patient id, patient class.
COPIES = {(): 5, ("date",): 3, ("pid",): 2, ("date", "pid"): 1, ("class",): 2}


def facilities() -> list[tuple]:
    kinds = ["Emergency Care"] * EMERGENCY + ["Urgent Care"] * FREESTANDING + ["Primary Care", "Medical Specialty"][:OTHER]
    return [(f"Facility {i + 1:02d}{' Freestanding' if k == 'Urgent Care' else ''}", 1001 + i, k, f"KY_County{i % 5}", f"{40000 + 111 * i}") for i, k in enumerate(kinds)]


def synthetic_visits(spark: SparkSession, seed: int = 42) -> DataFrame:
    """193 visits: 160 at emergency facilities, 20 elsewhere, and 13 repeated transmissions."""
    rng, places = random.Random(seed), facilities()
    regions = [f"KY_County{i}" for i in range(10)] + [f"TN_County{i}" for i in range(5)] + ["OTHER_REGION", None]

    def row(i: int, place: tuple) -> list:
        day = date(2023, 1, 1) + timedelta(days=rng.randrange(90))
        seen = datetime(day.year, day.month, day.day, rng.randrange(24), rng.randrange(60))
        region, pid, admitted = rng.choice(regions), f"P{rng.randrange(10**8):08d}", int(rng.random() < 0.2)
        return [*place, f"V{i:08d}", f"{day}{place[1]}{pid}", pid, day, seen, seen + timedelta(minutes=rng.randrange(600)), 1, admitted, rng.choice("EEEEEEEIIO"), region, None if region in (None, "OTHER_REGION") else f"{rng.randrange(40000, 43000)}", rng.choice("FM"), rng.randrange(95)]

    rows = [row(i, rng.choice(places[: EMERGENCY + FREESTANDING])) for i in range(BASE)] + [row(BASE + i, rng.choice(places[EMERGENCY + FREESTANDING :])) for i in range(ELSEWHERE)]
    originals = iter(rng.sample(range(BASE), sum(COPIES.values())))
    for changes, n in COPIES.items():
        for _ in range(n):
            copy = list(rows[next(originals)])
            if "date" in changes:
                copy[8] += timedelta(days=1)
            if "pid" in changes:
                copy[7] = "P" + copy[7][:0:-1] + "X"
            if "class" in changes:
                copy[13] = "I" if copy[13] != "I" else "E"
            copy[10] += timedelta(hours=6)
            copy[6] += "-2"
            rows.append(copy)
    return spark.createDataFrame([tuple(r) for r in rows], VISITS)


def cleaned_visits(spark: SparkSession, seed: int = 42) -> DataFrame:
    """The invented visits after the usual preparation: 160 rows, 21 columns."""
    from ..operators import assign_treating_geography, dedupe, filter_care_setting

    fixed = [name for name, _, kind, *_ in facilities() if kind == "Urgent Care"]
    return (
        synthetic_visits(spark, seed)
        .transform(dedupe, keep="last", order_by="Arrived_Date_Time", order_key=["Arrived_Date_Time", "C_BioSense_ID"])
        .transform(filter_care_setting, fix_facility_type_vector=fixed)
        .transform(assign_treating_geography, preserve_original_geographies=True)
    )
