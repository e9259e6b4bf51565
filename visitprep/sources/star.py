"""Visits projected from the star-schema tables that the driver supplies."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A total order of the rows of one facility and visit.
ORDER_KEY = ["arrived_date_time", "line_number", "part_key"]

#: Visit columns as expressions over the joined tables; they read alike in Spark and DuckDB.
COLUMNS = {
    "hospital_name": "s_name",
    "hospital": "s_suppkey",
    "visit_id": "concat('V', cast(l_orderkey as string))",
    "facility_type": "case when s_suppkey % 10 <= 5 then 'Emergency Care' when s_suppkey % 10 = 6 then 'Inpatient Practice Setting' when s_suppkey % 10 = 7 then 'Urgent Care' when s_suppkey % 10 = 8 then 'Primary Care' else 'Medical Specialty' end",
    "hospital_region": "concat('KY_', sn.n_name)",
    "hospital_zip": "lpad(cast(s_nationkey as string), 5, '0')",
    "region": "case when o_custkey % 23 = 0 then null when o_custkey % 19 = 0 then 'OTHER_REGION' when o_custkey % 17 = 0 then 'KY_UNKNOWN' when cn.n_regionkey < 3 then concat('KY_', cn.n_name) else concat('TN_', cn.n_name) end",
    "zip_code": "case when o_custkey % 23 = 0 then null else lpad(cast(c_nationkey as string), 5, '0') end",
    "date": "make_date(year(l_shipdate), 1, 1)",
    "c_unique_patient_id": "concat('P', cast(l_partkey % 2 as string))",
    "c_bio_sense_id": "concat(cast(year(l_shipdate) as string), '-', cast(s_suppkey as string), '-P', cast(l_partkey % 2 as string))",
    "c_patient_class": "case l_returnflag when 'A' then 'E' when 'R' then 'I' else 'O' end",
    "arrived_date_time": "l_shipdate",
    "line_number": "l_linenumber",
    "part_key": "l_partkey",
}
FLAGS = {
    "has_been_e": "case when l_returnflag = 'A' then 1 else 0 end",
    "has_been_admitted": "case when l_returnflag = 'R' or l_linestatus = 'F' then 1 else 0 end",
    "has_been_o": "case when l_returnflag = 'N' and l_linestatus = 'O' then 1 else 0 end",
}
CLASS_LIST = {
    "c_patient_class_list": "case when l_returnflag = 'A' and l_linestatus = 'F' then 'EI' when l_returnflag = 'A' then 'E' when l_returnflag = 'R' and l_linestatus = 'F' then 'D' when l_returnflag = 'R' then 'I' when l_partkey % 7 = 0 then null else 'O' end",
}
MERGED = {
    "ccdd": "concat(p_type, ';', p_brand, '|R', cast(l_partkey % 5 as string))",
    "ccdd_category_flat": "concat(p_brand, ';', p_type)",
    "c_death": "case when l_quantity > 40 then 'Yes' when l_quantity < 5 then null else 'No' end",
    "discharge_disposition": "case when l_linenumber % 4 = 0 then null when l_linenumber % 4 = 1 then '' else concat('DISP_', cast(l_linenumber as string)) end",
}
#: The 18 columns of a raw pull, in order, by the names they have there.
RAW = {
    "HospitalName": COLUMNS["hospital_name"],
    "Hospital": "cast(s_suppkey as int)",
    "FacilityType": COLUMNS["facility_type"],
    "HospitalRegion": COLUMNS["hospital_region"],
    "HospitalZip": COLUMNS["hospital_zip"],
    "Visit_ID": COLUMNS["visit_id"],
    "C_BioSense_ID": COLUMNS["c_bio_sense_id"],
    "C_Unique_Patient_ID": "concat('P', cast(l_partkey as string))",
    "Date": "cast(l_shipdate as date)",
    "C_Visit_Date_Time": "l_shipdate",
    "Arrived_Date_Time": "l_shipdate + make_interval(0, 0, 0, 0, l_linenumber)",
    "HasBeenE": FLAGS["has_been_e"],
    "HasBeenAdmitted": FLAGS["has_been_admitted"],
    "C_Patient_Class": COLUMNS["c_patient_class"],
    "Region": COLUMNS["region"],
    "ZipCode": COLUMNS["zip_code"],
    "Sex": "case when o_custkey % 2 = 0 then 'F' else 'M' end",
    "C_Patient_Age": "cast(o_custkey % 95 as int)",
}
FROM = """lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey
 join nation sn on s_nationkey = sn.n_nationkey join customer on o_custkey = c_custkey join nation cn on c_nationkey = cn.n_nationkey"""

#: The same joins for Spark, which keeps this order: orders meet customers before lines, so rows of lines travel
#: once, without names; small tables come last.
SPARK_FROM = """lineitem join (orders join customer on o_custkey = c_custkey) on l_orderkey = o_orderkey{part} join supplier on l_suppkey = s_suppkey
 join nation sn on s_nationkey = sn.n_nationkey join nation cn on c_nationkey = cn.n_nationkey"""


def select_sql(columns: dict[str, str], where: str = "", dialect: str = "duckdb") -> str:
    """The projection as SQL; one text serves both engines up to the name of the string type."""
    listed = ", ".join(f"{e} as {c}" for c, e in columns.items())
    part = " join part on l_partkey = p_partkey" if any("p_" in e.replace("s_suppkey", "") for e in columns.values()) else ""
    tables = SPARK_FROM.format(part=part) if dialect == "spark" else FROM + part
    sql = f"select {listed} from {tables}" + (f" where {where}" if where else "")
    return sql if dialect == "spark" else sql.replace("as string)", "as varchar)").replace("make_interval(0, 0, 0, 0, l_linenumber)", "to_hours(cast(l_linenumber as int))")


def _selected(spark: SparkSession, sf_dir: str, columns: dict[str, str], where: str = "") -> DataFrame:
    sql = select_sql(columns, where, "spark")
    names = ("lineitem", "orders", "supplier", "nation", "customer", "part")
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names if name != "part" or " part " in sql}
    for name in tables:
        sql = re.sub(rf"(?<=[ (]){name}(?= )", f"{{{name}}}", sql)
    # sql() takes frames by name, so nothing is registered in the session.
    return spark.sql(sql, **tables)


def visits(spark: SparkSession, sf_dir: str, *more: dict[str, str], where: str = "") -> DataFrame:
    """The visit rows of the tables in ``sf_dir``; ``more`` adds columns."""
    return _selected(spark, sf_dir, {k: v for part in (COLUMNS, *more) for k, v in part.items()}, where)


def raw_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables as a raw pull, with the names and the order of ``schema.VISITS``."""
    return _selected(spark, sf_dir, RAW)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as visits: a facility for each user, one facility type, and event days."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    return table.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("hospital_name"), F.col("event_type").alias("facility_type"), F.col("ts").cast("date").alias("date"))
