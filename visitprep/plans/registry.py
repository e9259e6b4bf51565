"""Every query of the visit engine by name, with the SQL that states the same result.

A query runs an operator over all visits of the tables; those of two pulls leave out 'N' rows, which
are in neither pull.  Leading dots of metadata columns are taken
off, so that both engines name columns alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import operators as op
from ..functions.names import col, snake
from ..functions.timestamps import parse_timestamp, parse_updates
from ..sources import star
from ..sources.star import CLASS_LIST, FLAGS, MERGED, ORDER_KEY

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Types of duplicated visits as column names of the wide table.
TYPES = {t: t.replace("+", "_and_") for t in op.duplicates.duplicate_types()}
NAMES = [f"Supplier#{n:09d}" for n in (7, 17)]
PATTERN = "[38]$"


def plain(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.removeprefix(".") for c in df.columns])


def in_order(df: DataFrame) -> DataFrame:
    """A sorted report with the place of each row in it, so that its order is compared too."""
    return df.withColumn("__place", F.monotonically_increasing_id()).withColumn("rank", F.row_number().over(Window.orderBy("__place"))).drop("__place")


def placed(order: str) -> str:
    return f"(row_number() over (order by {order}))::int rank"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def base(*more: dict[str, str], where: str = "") -> str:
    return star.select_sql({k: v for part in (star.COLUMNS, *more) for k, v in part.items()}, where)


KEY, ORDER = "hospital_name, visit_id", "arrived_date_time, line_number, part_key"
DESCENDING = "arrived_date_time desc, line_number desc, part_key desc"
V = f"with v as ({base()})"
COLS = ", ".join(star.COLUMNS)

# ---- one row for each visit --------------------------------------------------------------------


def _first(order: str, source: str = "v") -> str:
    return f"select {COLS} from (select *, row_number() over (partition by {KEY} order by {order}) rn from {source}) where rn = 1"


for _name, _args, _order in (
    ("dedupe_first_ordered", {"keep": "first", "order_by": "zip_code"}, f"zip_code asc nulls last, {ORDER}"),
    ("dedupe_last_ordered", {"keep": "last", "order_by": "zip_code"}, f"zip_code desc nulls first, {DESCENDING}"),
    ("dedupe_first_unordered", {"keep": "first"}, ORDER),
    ("dedupe_last_unordered", {"keep": "last"}, DESCENDING),
):
    query(_name, f"{V} {_first(_order)}")(lambda spark, d, a=_args: op.dedupe(star.visits(spark, d), order_key=ORDER_KEY, **a))

_complete = " + ".join(f"case when {c} is null then 0 else 1 end" for c in (*star.COLUMNS, *MERGED))
query("dedupe_most_complete", f"with v as ({base(MERGED)}) select {COLS}, {', '.join(MERGED)} from (select *, row_number() over (partition by {KEY} order by {_complete} desc, {ORDER}) rn from v) where rn = 1")(
    lambda spark, d: op.dedupe(star.visits(spark, d, MERGED), keep="most_complete", order_key=ORDER_KEY)
)

# ---- duplicates --------------------------------------------------------------------------------

GROUPS = f"{V}, g as (select {KEY}, count(*) n_rows from v group by all)"
query("dup_ids", f"{GROUPS} select {KEY} from g where n_rows > 1")(lambda spark, d: op.summarize_duplicates(star.visits(spark, d)).duplicate_ids)

# Tenths of a percent, halves to even.
def _tenths(part: str, whole: str) -> str:
    q, r = f"(({part}) * 1000) // ({whole})", f"(({part}) * 1000) % ({whole})"
    return f"({q} + case when 2 * ({r}) > ({whole}) or (2 * ({r}) = ({whole}) and ({q}) % 2 = 1) then 1 else 0 end)"


query(
    "dup_by_facility",
    f"""{GROUPS}, f as (select hospital_name, count(*) n_visits, count(*) filter (n_rows > 1) n_duplicated_visit_ids,
 cast(sum(case when n_rows > 1 then n_rows - 1 else 0 end) as bigint) n_excess_rows from g group by 1 having count(*) filter (n_rows > 1) > 0)
 select *, {_tenths('n_duplicated_visit_ids', 'n_visits')} / 10 pct_duplicated, {placed('n_excess_rows desc, hospital_name')} from f""",
)(lambda spark, d: in_order(op.summarize_duplicates(star.visits(spark, d)).by_facility))
query(
    "dup_overall",
    f"""{GROUPS}, o as (select cast(sum(n_rows) as bigint) n_total_rows, count(*) n_unique_visits, count(*) filter (n_rows > 1) n_duplicated_visit_ids,
 cast(sum(case when n_rows > 1 then n_rows - 1 else 0 end) as bigint) n_excess_rows from g)
 select *, {_tenths('n_duplicated_visit_ids', 'n_unique_visits')} / 10 pct_duplicated from o""",
)(lambda spark, d: op.summarize_duplicates(star.visits(spark, d)).overall)

_causes = "concat_ws('+', case when n_dates > 1 then 'visit_date_change' end, case when n_pid > 1 then 'pid_change' end, case when n_patient_classes > 1 then 'patient_class_change' end)"
CLASSIFIED = f"""{V}, g as (select {KEY}, count(*) n_rows, count(distinct c_bio_sense_id) n_biosense_ids, count(distinct date) n_dates,
 count(distinct c_unique_patient_id) n_pid, count(distinct c_patient_class) n_patient_classes from v group by all),
 t as (select *, case when n_rows = 1 then 'no_duplication' when {_causes} = '' then 'type_unknown' else {_causes} end dup_type from g)"""


def _classified(spark: SparkSession, d: str) -> op.DuplicateClassification:
    return op.classify_duplicates(star.visits(spark, d), observed_types_only=False)


def _by_type(spark: SparkSession, d: str) -> DataFrame:
    return in_order(_classified(spark, d).by_facility.withColumnsRenamed(TYPES))


query("dup_groups", f"{CLASSIFIED} select * from t")(lambda spark, d: _classified(spark, d).visit_groups)
query("dup_classified_ids", f"{CLASSIFIED} select {KEY} from t where dup_type <> 'no_duplication'")(lambda spark, d: _classified(spark, d).duplicate_ids)
query(
    "dup_by_facility_type",
    f"""{CLASSIFIED}, f as (select hospital_name, {', '.join(f"""count(*) filter (dup_type = '{t}') {c}""" for t, c in TYPES.items())}, count(*) n_duplicated_total from t where dup_type <> 'no_duplication' group by 1)
 select *, {placed('n_duplicated_total desc, hospital_name')} from f""",
)(_by_type)
query(
    "dup_type_overall",
    f"""{CLASSIFIED}, o as (select dup_type, count(*) n, (select count(*) from t where dup_type <> 'no_duplication') as whole from t where dup_type <> 'no_duplication' group by 1)
 select dup_type, n, concat({_tenths('n', 'whole')} // 10, '.', {_tenths('n', 'whole')} % 10, '%') percent, {placed('n desc, dup_type')} from o""",
)(lambda spark, d: in_order(_classified(spark, d).overall))
query("dup_rows_semi", f"{GROUPS} select v.* from v semi join (select * from g where n_rows > 1) using ({KEY})")(lambda spark, d: op.only_duplicated(v := star.visits(spark, d), op.summarize_duplicates(v)))
query("dup_rows_anti", f"{GROUPS} select v.* from v anti join (select * from g where n_rows > 1) using ({KEY})")(lambda spark, d: op.only_unique(v := star.visits(spark, d), op.summarize_duplicates(v)))
query("dup_rows_labeled", f"{CLASSIFIED} select v.*, t.* exclude ({KEY}) from v join t using ({KEY})")(lambda spark, d: op.label_rows(v := star.visits(spark, d), op.classify_duplicates(v)))

# ---- care settings -----------------------------------------------------------------------------

DEFAULT = "('Emergency Care', 'Inpatient Practice Setting')"
_IDS, _NAMES = "hospital in (7, 27, 8)", "hospital_name in ('" + "', '".join(NAMES) + "')"
# The pattern leaves out names that an id or a listed name corrected.
_REGEX = f"regexp_matches(hospital_name, '{PATTERN}')"
_FIXED = "'Emergency Care'"
_ALL = f"case when {_REGEX} and not ({_NAMES}) and hospital_name not in (select hospital_name from v where {_IDS}) then {_FIXED} when {_NAMES} or {_IDS} then {_FIXED} else facility_type end"


def _kept(fixed: str, keep: str = DEFAULT) -> str:
    return f"{V}, c as (select * replace ({fixed} as facility_type) from v) select * from c where facility_type in {keep}"


_every = {"fix_facility_id_vector": [7, 27.0, "8"], "fix_facility_type_vector": NAMES, "fix_facility_type_regex": PATTERN}
for _name, _args, _sql in (
    ("care_keep_default", {}, _kept("facility_type")),
    ("care_keep_ed_only", {"keep_types": ["Emergency Care"]}, _kept("facility_type", "('Emergency Care')")),
    ("care_fix_id", {"fix_facility_id_vector": [7, "27", 8]}, _kept(f"case when {_IDS} then {_FIXED} else facility_type end")),
    ("care_fix_name", {"fix_facility_type_vector": NAMES}, _kept(f"case when {_NAMES} then {_FIXED} else facility_type end")),
    ("care_fix_regex", {"fix_facility_type_regex": PATTERN}, _kept(f"case when {_REGEX} then {_FIXED} else facility_type end")),
    ("care_fix_all", _every, _kept(_ALL)),
    (
        "care_dry_run",
        {**_every, "dry_run": True},
        f"{V}, c as (select *, {_ALL} fixed from v), n as (select hospital_name facility, hospital facility_id, facility_type original_facility_type, fixed corrected_facility_type, count(*) n_visits, fixed in {DEFAULT} would_keep from c group by all) select *, {placed('n_visits desc, facility, original_facility_type')} from n",
    ),
):
    query(_name, _sql)(lambda spark, d, a=_args: (in_order if a.get("dry_run") else lambda df: df)(plain(op.filter_care_setting(star.visits(spark, d), **a))))

# ---- review of facilities ----------------------------------------------------------------------


def _review(method: str, *, daily: bool = False, by_type: bool = False, every: bool = False, source: str = V) -> str:
    figure = "visits_per_day" if daily else "n_visits"
    over = "over (partition by facility_type)" if by_type else "over ()"
    at = lambda p: f"quantile_cont({figure}, {p}) {over}"
    low, high = [], []
    if method != "iqr":
        low.append("p_low")
        high.append("p_high")
    if method != "percentile":
        low.append("q1 - (q3 - q1) * 1.5")
        high.append("q3 + (q3 - q1) * 1.5")
    days = ", count(distinct date) n_days, count(*) / count(distinct date) visits_per_day" if daily else ""
    below, above = (" or ".join(f"{figure} {sign} {x}" for x in xs) for sign, xs in (("<", low), (">", high)))
    return f"""{source}, c as (select hospital_name, facility_type, count(*) n_visits{days} from v group by 1, 2),
 l as (select *, {at(0.05)} p_low, {at(0.95)} p_high, {at(0.25)} q1, {at(0.75)} q3 from c),
 f as (select *, {below} outlier_low, {above} outlier_high from l)
 select * exclude (p_low, p_high, q1, q3), outlier_low or outlier_high outlier_flag,
 case when outlier_low and outlier_high then 'both' when outlier_low then 'low' when outlier_high then 'high' end outlier_direction,
 case when outlier_low or outlier_high then '{method}' end outlier_method from f{"" if every else " where outlier_low or outlier_high"}"""


_EVENTS = "with v as (select concat('U', cast(user_id as varchar)) hospital_name, event_type facility_type, cast(ts as date) date from events)"
for _name, _args, _sql in (
    ("review_pct", {"method": "percentile"}, _review("percentile")),
    ("review_iqr", {"method": "iqr"}, _review("iqr")),
    ("review_both", {"method": "both"}, _review("both")),
    ("review_pct_daily", {"method": "percentile", "date_col": "Date"}, _review("percentile", daily=True)),
    ("review_iqr_by_type", {"method": "iqr", "group_by_type": True}, _review("iqr", by_type=True)),
    ("review_both_daily_by_type", {"method": "both", "date_col": "Date", "group_by_type": True}, _review("both", daily=True, by_type=True)),
    ("review_all", {"method": "both", "return_format": "all"}, _review("both", every=True)),
):
    query(_name, _sql)(lambda spark, d, a=_args: plain(op.review_facility_ed_visits(star.visits(spark, d), **a)))
_figures = "outlier_flag desc, n_visits, hospital_name, facility_type"
query("review_events_iqr", f"select *, {placed('outlier_direction desc, n_visits, hospital_name, facility_type')} from ({_review('iqr', source=_EVENTS)})")(
    lambda spark, d: in_order(plain(op.review_facility_ed_visits(star.events(spark, d), method="iqr")))
)
query("review_events_ordered", f"select *, {placed(_figures)} from ({_review('both', every=True, by_type=True, source=_EVENTS)})")(
    lambda spark, d: in_order(plain(op.review_facility_ed_visits(star.events(spark, d), method="both", group_by_type=True, return_format="all")))
)
query("review_events_daily", _review("both", daily=True, every=True, source=_EVENTS))(
    lambda spark, d: plain(op.review_facility_ed_visits(star.events(spark, d), method="both", date_col="date", return_format="all"))
)

# ---- episodes ----------------------------------------------------------------------------------

PASSED = ", ".join(c for c in star.COLUMNS)
MERGE = {"CCDD": "union_ccdd", "CCDDCategory_flat": "union_delimited", "C_Death": "prefer_yes", "Discharge_Disposition": "prefer_admission"}
_LABELS = "case code when 'E' then 'ED' when 'I' then 'Inpatient' when 'D' then 'Direct Admit' when 'O' then 'Outpatient' else code end"
_FLAGGED = " union all ".join(f"select * exclude ({', '.join(FLAGS)}), {i} place, '{label}' patient_class from {{}} where {c} = 1" for i, (c, label) in enumerate(zip(FLAGS, ("ED", "Admitted", "Outpatient"), strict=True)))
_IN_A_PULL = "l_returnflag in ('R', 'A')"


def _pulls(spark: SparkSession, d: str, *more: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The emergency pull, and an inpatient pull with all of its rows, which the linkage leaves out again."""
    timed = {"c_visit_date_time": "l_shipdate"}
    return star.visits(spark, d, FLAGS, timed, *more, where="l_returnflag = 'A'"), star.visits(spark, d, FLAGS, timed, *more, where="l_returnflag in ('R', 'A')")


def _long(source: str, timed: bool) -> str:
    """Rows of one class each, ``l``, with sequence and size of their episodes as ``m``."""
    time = "min(c_visit_date_time)" if timed else "null"
    return f"""{source}, cl as (select {KEY}, patient_class, {time} first_time from l where patient_class is not null group by {KEY}, patient_class),
 sq as (select {KEY}, string_agg(patient_class, '->' order by first_time asc nulls last, patient_class) patient_class_sequence from cl group by {KEY}),
 n as (select {KEY}, count(*) episode_n_rows from l group by {KEY}),
 m as (select l.*, concat(l.hospital_name, '_', l.visit_id) episode_id, patient_class_sequence, episode_n_rows,
 patient_class = 'ED' or (patient_class <> 'ED' and episode_n_rows = 1) index_encounter
 from l join n using ({KEY}) left join sq using ({KEY}))"""


_FLAGS_SQL = f"with s as ({base(FLAGS)}), l as ({_FLAGGED.format('s', 's', 's')})"
_LIST_SQL = f"""with s as ({base(CLASS_LIST)}), l as (select * exclude (code), {_LABELS} patient_class from
 (select *, unnest(case when c_patient_class_list is null then [null] else string_split(c_patient_class_list, '') end) code, 0 place from s))"""
_TIMED = {"c_visit_date_time": "l_shipdate"}
_PULLS_SQL = f"""with s as ({base(FLAGS, _TIMED, MERGED, where="l_returnflag = 'A'")}), i as ({base(FLAGS, _TIMED, MERGED, where=_IN_A_PULL)}),
 l as (select *, 0 source from ({_FLAGGED.format('s', 's', 's')}) union all by name select *, 0 place, 'Direct Admit' patient_class, 1 source from i where has_been_e = 0)"""
_OUT = f"{PASSED}, patient_class, episode_id, patient_class_sequence, episode_n_rows, index_encounter"

query("link_long_flags", f"{_long(_FLAGS_SQL, False)} select {_OUT} from m")(lambda spark, d: plain(op.link_encounters(star.visits(spark, d, FLAGS), return_format="long", order_key=ORDER_KEY)))
query("link_long_classlist", f"{_long(_LIST_SQL, False)} select {_OUT}, c_patient_class_list from m")(
    lambda spark, d: plain(op.link_encounters(star.visits(spark, d, CLASS_LIST), return_format="long", order_key=ORDER_KEY))
)
_wide = f"{_OUT}, c_visit_date_time, {', '.join(MERGED)}, {', '.join(FLAGS)}"
query("link_long_two_pull", f"{_long(_PULLS_SQL, True)} select {_wide} from m")(lambda spark, d: plain(op.link_encounters(*_pulls(spark, d, MERGED), return_format="long", order_key=ORDER_KEY)))
query("link_sequence_counts", f"{_long(_PULLS_SQL, True)} select patient_class_sequence, count(*) n_rows, count(distinct episode_id) n_episodes from m group by 1")(
    lambda spark, d: plain(op.link_encounters(*_pulls(spark, d), return_format="long", order_key=ORDER_KEY)).groupBy("patient_class_sequence").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("episode_id").alias("n_episodes"))
)
_RANKED = f"r as (select *, row_number() over (partition by {KEY} order by case when patient_class = 'ED' then 0 else 1 end, {{}}{ORDER}, place) rn from m)"
query("link_collapsed_flags", f"{_long(_FLAGS_SQL, False)}, {_RANKED.format('')} select {_OUT.replace('index_encounter', 'true index_encounter')} from r where rn = 1")(
    lambda spark, d: plain(op.link_encounters(star.visits(spark, d, FLAGS), order_key=ORDER_KEY, merge_fields={}))
)

# Sorted by episode id: rows that come after a row of a larger id, within a part of the result or between parts.
def _sorted_episodes(spark: SparkSession, d: str) -> DataFrame:
    rows = plain(op.link_encounters(*_pulls(spark, d), merge_fields={}, order_key=ORDER_KEY, sort=True))
    place = F.monotonically_increasing_id()
    rows = rows.select(F.spark_partition_id().alias("part"), place.alias("place"), "episode_id")
    before = F.lag("episode_id").over(Window.partitionBy("part").orderBy("place"))
    parts = rows.withColumn("before", before).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("before") > F.col("episode_id"), 1)).alias("bad"), F.min("episode_id").alias("low"), F.max("episode_id").alias("high"))
    ends = parts.withColumn("last", F.lag("high").over(Window.orderBy("part")))  # a row for each part
    return ends.agg(F.sum("n").alias("n_rows"), (F.sum("bad") + F.count(F.when(F.col("last") > F.col("low"), 1))).alias("n_out_of_order"), F.min("low").alias("first_id"), F.max("high").alias("last_id"))


query("link_collapsed_sorted", f"{_long(_PULLS_SQL, True)} select count(distinct (hospital_name, visit_id)) n_rows, 0::bigint n_out_of_order, min(episode_id) first_id, max(episode_id) last_id from m")(_sorted_episodes)

# Lists of an episode's values in row order, and unions of their parts in order of appearance.
_BY = f"order by source, {ORDER}, place"


def _union(values: str) -> str:
    parts = f"list_filter(list_transform(flatten(list_transform(list_filter({values}, lambda x: x is not null and x <> ''), lambda x: string_split(x, ';'))), lambda p: trim(p)), lambda p: p <> '')"
    return f"list_aggregate(list_filter({parts}, lambda p, i: list_position({parts}, p) = i), 'string_agg', ';')"


def _collapsed(fields: dict[str, str]) -> str:
    """Two pulls collapsed, with an expression over lists for each merged field."""
    lists = ", ".join(f"list({c} {_BY}) {c}_all" for c in MERGED)
    largest = ", ".join(f"max({c}) {c}_max" for c in FLAGS)
    merged = ", ".join(f"case when episode_n_rows > 1 then {fields.get(c, c)} else {c} end {c}" for c in MERGED)
    return f"""{_long(_PULLS_SQL, True)}, {_RANKED.format('source, ')},
 a as (select {KEY}, list(patient_class {_BY}) classes, {lists}, {largest} from m group by {KEY})
 select {', '.join(c for c in star.COLUMNS)}, patient_class, episode_id, patient_class_sequence, episode_n_rows, true index_encounter, c_visit_date_time,
 {merged}, {', '.join(f'{c}_max {c}' for c in FLAGS)} from r join a using ({KEY}) where rn = 1"""


_half = lambda i: f"list_transform(ccdd_all, lambda x: split_part(x, '|', {i}))"
_FIELDS = {
    "ccdd": f"concat({_union(_half(1))}, '|', {_union(_half(2))})",
    "ccdd_category_flat": _union("ccdd_category_flat_all"),
    "c_death": "coalesce(list_filter(c_death_all, lambda x: lower(x) in ('yes', '1'))[1], c_death)",
    "discharge_disposition": "coalesce(list_filter(list_zip(classes, discharge_disposition_all), lambda x: x[1] in ('Inpatient', 'Direct Admit', 'Admitted') and x[2] is not null and x[2] <> '')[1][2], discharge_disposition)",
}


def _linked(fields: dict[str, str]) -> Query:
    return lambda spark, d: plain(op.link_encounters(*_pulls(spark, d, MERGED), merge_fields=fields, order_key=ORDER_KEY))


query("link_collapsed_two_pull", _collapsed(_FIELDS))(_linked(MERGE))
for _short, _field, _strategy in (("union", "ccdd_category_flat", "union_delimited"), ("ccdd", "ccdd", "union_ccdd"), ("yes", "c_death", "prefer_yes"), ("admission", "discharge_disposition", "prefer_admission")):
    query(f"merge_{_short}", _collapsed({_field: _FIELDS[_field]}))(_linked({_field: _strategy}))
_some = "list_filter(discharge_disposition_all, lambda x: x is not null and x <> '')"
_base = f"case when discharge_disposition <> '' then discharge_disposition else {_some}[1] end"
_concat = f"case when len({_some}) = 0 then discharge_disposition else list_reduce(list_prepend({_base}, {_some}), lambda t, v: case when contains(t, v) then t else concat(t, '; ', v) end) end"
query("merge_concat", _collapsed({"discharge_disposition": _concat}))(_linked({"discharge_disposition": "concat"}))

# ---- expressions -------------------------------------------------------------------------------

_FORMS = {
    "iso_t": ("date_format(l_shipdate, \"yyyy-MM-dd'T'HH:mm:ss\")", "strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S')", "l_shipdate"),
    "us_minutes": ("concat(date_format(l_shipdate, 'MM/dd/yyyy'), ' 08:30')", None, "l_shipdate + interval 510 minute"),
    "zulu": ("concat(date_format(l_shipdate, 'yyyy-MM-dd'), ' 14:05:00 Z')", None, "l_shipdate + interval 845 minute"),
    "with_text": ("concat(date_format(l_shipdate, 'yyyy-MM-dd'), ' noon')", None, "l_shipdate"),
    "junk": ("concat('no time ', l_linenumber)", None, "cast(null as timestamp)"),
}


def _timestamps(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", *[f"{e} as t_{k}" for k, (e, *_) in _FORMS.items()])
    return lines.select("l_orderkey", "l_linenumber", *[parse_timestamp(F.col(f"t_{k}")).alias(k) for k in _FORMS])


query("parse_timestamps", f"select l_orderkey, l_linenumber, {', '.join(f'{e[2]} {k}' for k, e in _FORMS.items())} from lineitem")(_timestamps)


# Update lists of an order from its lines by part: positions with gaps, repeats and out of range, blanks, segments
# without a time and free text.
_AT = "case when l_partkey % 7 = 0 then 9 else l_linenumber % 5 end"
_CLEAR = "l_partkey % 6 > 0 and l_partkey % 11 > 0"


def _updates(spark: SparkSession, d: str) -> DataFrame:
    segment = f"case when l_partkey % 6 = 0 then 'free text' when l_partkey % 11 = 0 then concat('{{', {_AT}, '}};') when l_partkey % 2 = 0 then concat(' {{', {_AT}, '}} ; t', l_partkey % 100, ' ;') else concat('{{', {_AT}, '}};t', l_partkey % 100, ';') end"
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.expr("struct(l_partkey, l_linenumber, l_suppkey)").alias("at"), F.expr(segment).alias("segment"))
    lists = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("at", "segment"))).alias("rows"))
    got = parse_updates(F.array_join(F.transform("rows", lambda r: r["segment"]), "|"), F.lit(4))
    return lists.select("l_orderkey", F.concat_ws(",", F.transform(got, lambda x: F.coalesce(x, F.lit("-")))).alias("times"))


_time_at = ", ".join(f"coalesce(arg_max(concat('t', l_partkey % 100), (l_partkey, l_linenumber, l_suppkey)) filter ({_CLEAR} and {_AT} = {i}), '-')" for i in range(1, 5))
query("parse_class_updates", f"select l_orderkey, concat_ws(',', {_time_at}) times from lineitem group by l_orderkey")(_updates)

# ---- geography ---------------------------------------------------------------------------------

_OUTSIDE = "(region is null or region in ('OTHER_REGION', 'KY_UNKNOWN') or not starts_with(region, 'KY_'))"
_moved = lambda c, h, mask: f"case when {mask} then {h} else {c} end as {c}"
_BOTH = f"{_moved('region', 'hospital_region', _OUTSIDE)}, {_moved('zip_code', 'hospital_zip', _OUTSIDE)}"
_WAS = "case when {0} then region end original_region, case when {0} then zip_code end original_zip_code"
for _name, _f, _args, _sql in (
    ("geo_treating", op.assign_treating_geography, {}, f"{V} select * replace ({_BOTH}), {_OUTSIDE} out_of_state from v"),
    ("geo_treating_preserve", op.assign_treating_geography, {"preserve_original_geographies": True}, f"{V} select * replace ({_BOTH}), {_OUTSIDE} out_of_state, {_WAS.format(_OUTSIDE)} from v"),
    ("geo_treating_zip_only", op.assign_treating_geography, {"geography": ["zip"]}, f"{V} select * replace ({_moved('zip_code', 'hospital_zip', _OUTSIDE)}), {_OUTSIDE} out_of_state from v"),
    ("geo_facility", op.assign_facility_geography, {}, f"{V} select * replace (hospital_region as region, hospital_zip as zip_code), true facility_geography from v"),
    ("geo_facility_preserve", op.assign_facility_geography, {"preserve_original_geographies": True}, f"{V} select * replace (hospital_region as region, hospital_zip as zip_code), true facility_geography, {_WAS.format('true')} from v"),
):
    query(_name, _sql)(lambda spark, d, f=_f, a=_args: plain(f(star.visits(spark, d), **a)))

# ---- the whole pipeline ------------------------------------------------------------------------


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return (
        star.visits(spark, d)
        .transform(op.dedupe, keep="last", order_by="arrived_date_time", order_key=ORDER_KEY)
        .transform(op.filter_care_setting, fix_facility_type_vector=NAMES)
        .transform(op.assign_treating_geography, preserve_original_geographies=True)
    )


_PIPELINE = f"""{V}, o as ({_first(DESCENDING)}), c as (select * replace (case when {_NAMES} then {_FIXED} else facility_type end as facility_type) from o),
 p as (select * replace ({_BOTH}), {_OUTSIDE} out_of_state, {_WAS.format(_OUTSIDE)} from c where facility_type in {DEFAULT})"""
query("pipeline_clean", f"{_PIPELINE} select * from p")(lambda spark, d: plain(_clean(spark, d)))
query("pipeline_region_counts", f"{_PIPELINE} select region, count(*) n_visits, count(*) filter (out_of_state) n_out_of_state from p group by 1")(
    lambda spark, d: _clean(spark, d).groupBy("region").agg(F.count(F.lit(1)).alias("n_visits"), F.count(F.when(col(".out_of_state"), 1)).alias("n_out_of_state"))
)


# ---- the two datasets, as whole tables -----------------------------------------------------------

_RAW = f"with v as ({star.select_sql(star.RAW)})"
_RAW_ORDER = ["Arrived_Date_Time", "C_Unique_Patient_ID", "C_BioSense_ID"]
query("dataset_raw", f"{_RAW} select * from v")(star.raw_visits)


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    return plain(
        star.raw_visits(spark, d)
        .transform(op.dedupe, keep="last", order_by="Arrived_Date_Time", order_key=_RAW_ORDER)
        .transform(op.filter_care_setting, fix_facility_type_vector=NAMES)
        .transform(op.assign_treating_geography, preserve_original_geographies=True)
    )


_snake = ", ".join(f"{c} as {snake(c)}" for c in star.RAW)
_LAST = "arrived_date_time desc, c_unique_patient_id desc, c_bio_sense_id desc"
query(
    "dataset_cleaned",
    f"""with r as ({star.select_sql(star.RAW)}), v as (select {_snake} from r),
 o as (select * exclude (rn) from (select *, row_number() over (partition by {KEY} order by {_LAST}) rn from v) where rn = 1),
 c as (select * replace (case when {_NAMES} then {_FIXED} else facility_type end as facility_type) from o)
 select * replace ({_BOTH}), {_OUTSIDE} out_of_state, {_WAS.format(_OUTSIDE)} from c where facility_type in {DEFAULT}""",
)(_cleaned)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

