"""Care episodes from emergency and inpatient records."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import diagnostics, merge
from ..functions.names import check_choice, clean_names as cleaned, col, resolve, resolve_optional, snake
from ..functions.ordering import ORDER, with_order
from ..functions.timestamps import as_timestamp, parse_timestamp, parse_updates, trimmed

#: Codes and labels of patient classes, and what they are called here; others pass through.
CLASSES = {
    "E": "ED",
    "I": "Inpatient",
    "D": "Direct Admit",
    "V": "Observation",
    "O": "Outpatient",
    "B": "Obstetrics",
    "P": "Preadmit",
    "R": "Recurring",
    "Emergency": "ED",
}
#: Flag columns and the classes they stand for; other has_been_ columns are "Other".
FLAGS = {"has_been_e": "ED", "has_been_admitted": "Admitted", "has_been_i": "Admitted", "has_been_o": "Outpatient"}
MERGE_FIELDS = {
    "CCDD": "union_ccdd",
    "CCDDParsed": "union_ccdd",
    "CCDDCategory_flat": "union_delimited",
    "C_Death": "prefer_yes",
    "Discharge_Disposition": "prefer_admission",
    "DispositionCategory": "prefer_admission",
}
DIRECT = "Direct Admit"
TIME, SOURCE, PLACE, ENTRIES = ".class_time", "__source", "__place", "__entries"
SEQUENCE, N_ROWS, INDEX = ".patient_class_sequence", ".episode_n_rows", ".index_encounter"
#: Rows of a visit from which it is linked in two steps, and how many such visits are, the largest.
HEAVY_ROWS, HEAVY_VISITS = 50_000, 10_000
#: Visits that a task counts at a time to find those; a visit of over 7 / 65,536 of all rows is never missed.
TRACKED = 1 << 15


def split_classes(value: Column) -> Column:
    """A class list as codes or labels; null and empty lists are one null class.

    A list with a comma or a lower-case letter holds labels between commas, any other holds one code
    in each character.  A trailing comma adds nothing.
    """
    labels = F.transform(F.split(F.regexp_replace(value, ",$", ""), ","), trimmed)
    codes = F.filter(F.split(value, ""), lambda c: c != "")
    return F.when(value.isNull() | (value == ""), F.array(F.lit(None).cast("string"))).when(value.contains(",") | value.rlike("[a-z]"), labels).otherwise(codes)


def class_label(code: Column) -> Column:
    out = F.when(code.isNull(), F.lit(None).cast("string"))
    for k, v in CLASSES.items():
        out = out.when(code == k, v)
    return out.otherwise(code)


def _from_lists(df: DataFrame, list_col: str, updates_col: str | None) -> DataFrame:
    """The classes of a record as ``ENTRIES``, with the times its update gives."""
    codes = split_classes(col(list_col).cast("string"))
    df = df.drop("patient_class", TIME).withColumn("__codes", codes)
    times = parse_updates(col(updates_col).cast("string"), F.size("__codes")) if updates_col else F.transform("__codes", lambda c: F.lit(None).cast("string"))
    return df.withColumn(ENTRIES, F.arrays_zip(F.col("__codes").alias("code"), times.alias("time"))).drop("__codes")


def _from_flags(df: DataFrame, keep_flags: bool) -> DataFrame:
    """The flags of a record that are 1 as ``ENTRIES``; records without any such flag are gone."""
    flags = [c for c in df.columns if c.startswith("has_been_")]
    code = lambda c: F.when(F.coalesce(col(c).cast("double") == 1, F.lit(False)), F.lit(FLAGS.get(c, "Other")))
    entries = F.filter(F.array(*[F.struct(code(c).alias("code"), F.lit(None).cast("string").alias("time")) for c in flags]), lambda e: e["code"].isNotNull())
    return df.select(*[col(c) for c in df.columns if keep_flags or c not in flags], entries.alias(ENTRIES)).filter(F.size(ENTRIES) > 0)


def _opened(df: DataFrame, order_key: Sequence[str] | None, listed: bool) -> DataFrame:
    """One row for each entry of a record, with the class and the time it gives and, by ``order_key``, its order."""
    df = df.select(*[col(c) for c in df.columns if c != ENTRIES], F.posexplode(ENTRIES).alias(PLACE, "__pair"))
    code = F.col("__pair")["code"]
    if listed:
        given = [col(TIME)] if TIME in df.columns else []
        df = df.withColumn(TIME, F.coalesce(parse_timestamp(F.col("__pair")["time"]), *given))
    df = df.withColumn("patient_class", class_label(code) if listed else code).drop("__pair")
    return with_order(df, order_key) if order_key else df


def _nought(df: DataFrame) -> Column:
    """Zero, from all columns that can be hashed.

    A figure with it reads what the rows read, so Spark makes the shuffles of the caller's joins once for both;
    without it they would be narrower ones of its own."""
    return F.xxhash64(*[col(c) for c, t in df.dtypes if "map<" not in t and "variant" not in t]).bitwiseAND(F.lit(0))


def _inpatient(df: DataFrame, verbose: bool) -> DataFrame:
    """Inpatient rows that the emergency pull does not have.

    If any row has an emergency flag of 1, only rows with 0 stay, so that nulls go too; else all stay.
    """
    flag = resolve_optional(df, "HasBeenE")
    if flag:
        diagnostics.inform(verbose, "inpatient rows with HasBeenE = 1 are left out: the emergency pull has them")
        # A row with 1 is itself the one that makes them go, so it never stays and 0 always does: that much is known before
        # any shuffle of the caller's joins.  Only other values ask for the figure of all rows, and where a flag
        # cannot have any, the optimizer leaves it out.
        other = col(flag).isNull() | ((col(flag) != 0) & (col(flag) != 1))
        found = df.agg(F.coalesce(F.max(F.when(col(flag) == 1, 1)), F.lit(0)).alias("__found")).scalar()
        df = df.filter((col(flag) == 0) | (other & (found == 0)))
    entry = F.struct(F.lit(DIRECT).alias("code"), F.lit(None).cast("string").alias("time"))
    return df.drop("patient_class").withColumns({ENTRIES: F.array(entry), SOURCE: F.lit(1)})


def _check_types(left: DataFrame, right: DataFrame) -> None:
    kinds = dict(left.dtypes)
    clashes = [f"{c} ({kinds[c]} and {t})" for c, t in right.dtypes if c in kinds and kinds[c] != t and "void" not in (kinds[c], t) and not c.startswith("__")]
    if clashes:
        raise ValueError(f"columns of the two pulls differ in type: {', '.join(clashes)}")


def class_sequence(classes_and_times: Column) -> Column:
    """Classes by first time, untimed ones last, ties by name, joined by arrows; null without classes.

    Takes an array of (untimed, time, class) structs, one for each class.
    """
    some = F.filter(classes_and_times, lambda x: x["class"].isNotNull())
    return F.when(F.size(some) > 0, F.array_join(F.transform(F.array_sort(some), lambda x: x["class"]), "->"))


def episode_id(facility: Column, visit: Column) -> Column:
    """Facility and visit with an underscore; a null reads NA."""
    return F.concat(F.coalesce(facility.cast("string"), F.lit("NA")), F.lit("_"), F.coalesce(visit.cast("string"), F.lit("NA")))


def link_encounters(
    ed_data: DataFrame,
    inpatient_admission_data: DataFrame | None = None,
    *,
    facility_col: str = "HospitalName",
    visit_col: str = "Visit_ID",
    merge_fields: Mapping[str, str] | None = None,
    merge_delimiter: str = ";",
    return_format: str = "collapsed",
    clean_names: bool = True,
    verbose: bool = True,
    order_key: Sequence[str] | None = None,
    keep_flags: bool = False,
    sort: bool = False,
    heavy_rows: int | None = HEAVY_ROWS,
    diagnostics_mode: str = "lazy",
) -> DataFrame:
    """Link records of one facility and visit into a care episode.

    Patient classes come from C_Patient_Class_List if there is one (with times from
    C_Patient_Class_MDT_Updates), else from the HasBeen flags, which are used up (``keep_flags`` keeps
    them).  Rows of the inpatient pull are direct admissions.  The long format has one row for each
    class; the collapsed one keeps an episode's first emergency row, or else its first row, takes the
    largest of each remaining flag and reconciles ``merge_fields`` over the episode; episodes of one
    row are left alone.

    Everything happens in one shuffle by facility and visit, whose windows share one sort.  It moves records as
    they are; their classes, keys and order become rows and columns after it.  Collapsing
    keeps a row where it is: windows mark the row that stays and gather the fields to merge, and only
    for episodes of several rows.  Episodes are always the two key columns, so ids that read alike
    cannot mix.

    Visits of more than ``heavy_rows`` records, such as those under a placeholder id, would each be one task.
    The 10,000 largest of them are found by sketched counts of hashed keys and take another way: first times by class,
    the row that stays and distinct values to merge are aggregated in two steps, before and after a
    shuffle, and rows of the long format stay where they are.  Any visit beyond those has less than
    7 / 65,536 of the rows, about a ten-thousandth; which visits these are changes no result.  ``heavy_rows=None`` leaves out the count.
    Names come back in snake case whether ``clean_names`` is set or not; only ``dedupe`` restores them.
    """
    check_choice("return_format", return_format, ("collapsed", "long"))
    fields = {snake(k): v for k, v in (MERGE_FIELDS if merge_fields is None else merge_fields).items()}
    if wrong := sorted({v for v in fields.values() if v not in merge.STRATEGIES}):
        raise ValueError(f"merge_fields has unknown strategies {', '.join(wrong)}; there are {', '.join(merge.STRATEGIES)}")
    ed = cleaned(ed_data)
    facility, visit = resolve(ed, facility_col), resolve(ed, visit_col)
    list_col = resolve_optional(ed, "C_Patient_Class_List")
    figures: dict[str, Column] = {}
    if list_col:
        updates_col = resolve_optional(ed, "C_Patient_Class_MDT_Updates")
        diagnostics.inform(verbose, "patient classes come from C_Patient_Class_List")
        figures["n_missing_lists"] = F.count(F.when(col(list_col).isNull() | (col(list_col).cast("string") == ""), 1))
        if updates_col:
            parsed = parse_updates(col(updates_col).cast("string"), F.size(split_classes(col(list_col).cast("string"))))
            unparsed = (col(updates_col).cast("string") != "") & (F.size(F.filter(parsed, lambda x: x.isNotNull())) == 0)
            figures["n_unparsed_updates"] = F.count(F.when(unparsed, 1))
    else:
        has = {c: resolve_optional(ed, c) for c in ("HasBeenE", "HasBeenAdmitted", "HasBeenI", "HasBeenO")}
        if not has["HasBeenE"]:
            raise ValueError("without C_Patient_Class_List the emergency pull needs HasBeenE")
        if not has["HasBeenAdmitted"] and not has["HasBeenI"]:
            raise ValueError("without C_Patient_Class_List the emergency pull needs HasBeenAdmitted or HasBeenI")
        if "patient_class" in ed.columns:
            raise ValueError("the emergency pull has a column patient_class, which the flags are to fill")
        diagnostics.inform(verbose, "patient classes come from the HasBeen flags")
        if has["HasBeenAdmitted"] and has["HasBeenI"]:
            diagnostics.inform(verbose, "HasBeenAdmitted is used and HasBeenI is not, since both are there")
            ed = ed.drop(has["HasBeenI"])
        if has["HasBeenO"]:
            figures["n_outpatient"] = F.count(F.when(col(has["HasBeenO"]) == 1, 1))

    def tell(f: dict) -> None:
        if f.get("n_missing_lists"):
            diagnostics.warn(f"{f['n_missing_lists']} rows have no class list; they stay, with a null patient class")
        if f.get("n_unparsed_updates"):
            diagnostics.warn(f"{f['n_unparsed_updates']} rows have class updates that could not be read; other times order their classes")
        if f.get("n_outpatient"):
            diagnostics.warn(f"{f['n_outpatient']} rows are outpatient visits; they are kept and labelled so")

    key = F.struct(col(facility).alias("facility"), col(visit).alias("visit")).alias("__key")
    # Visits of one hash are counted as one; whichever way they take, the result is the same.
    hashed = F.xxhash64(col(facility), col(visit)).alias("__hash")
    hashes = lambda df: df.select((hashed + _nought(df)).alias("__hash"))
    pulls = [hashes(ed)]
    if figures:
        ed = diagnostics.observed(ed, "link_encounters", diagnostics_mode, figures, tell)
    own_key = [resolve(ed, c) for c in order_key] if order_key else None
    late = own_key  # what the rows are ordered by after the shuffle, where both pulls name it alike
    inpatient = None
    if inpatient_admission_data is not None:
        inpatient = cleaned(inpatient_admission_data)
        if order_key and [resolve(inpatient, c) for c in order_key] != own_key:
            late = None
    if late and not set(late).isdisjoint({"patient_class", TIME, *(c for c in ed.columns if not list_col and not keep_flags and c.startswith("has_been_"))}):
        late = None  # a column that is used up
    if not late:
        ed = with_order(ed, order_key)
    rows = (_from_lists(ed, list_col, updates_col) if list_col else _from_flags(ed, keep_flags)).withColumn(SOURCE, F.lit(0))
    if inpatient is not None:
        extra = _inpatient(inpatient if late else with_order(inpatient, order_key), verbose)
        pulls.append(hashes(extra.drop("__key", ENTRIES, SOURCE)))
        if list_col and TIME in extra.columns:
            rows = rows.withColumn(TIME, F.lit(None).cast("timestamp_ntz"))
        _check_types(rows, extra)
        rows = rows.unionByName(extra, allowMissingColumns=True)
    opened = functools.partial(_opened, order_key=late, listed=bool(list_col))
    long = opened(rows)
    time = [F.col(f"`{TIME}`")] if TIME in long.columns else []
    if "c_visit_date_time" in long.columns:
        time.append(as_timestamp(long, "c_visit_date_time"))
    elif {"date", "time"} <= set(long.columns):
        text = lambda c: F.coalesce(col(c).cast("string"), F.lit("NA"))
        time.append(parse_timestamp(F.concat(text("date"), F.lit(" "), text("time"))))
    at = F.coalesce(*time) if time else F.lit(None).cast("timestamp_ntz")
    if not time:
        diagnostics.warn("no column gives a time, so classes are in alphabetical order")
    elif diagnostics_mode == "eager" and long.filter(at.isNotNull()).isEmpty():
        diagnostics.warn("no time could be read, so classes are in alphabetical order")
    whole = lambda df: opened(df).withColumn(TIME, at).withColumn("__key", key)
    columns = [c for c in long.columns if c not in (ORDER, SOURCE, PLACE, TIME, "__key", "patient_class")]
    fields = {k: v for k, v in fields.items() if k in columns} if return_format == "collapsed" else {}
    parts = [rows]
    if heavy_rows is not None:
        # Counts of a bounded number of visits, so no row for each visit travels.
        counted = functools.reduce(DataFrame.union, pulls).agg(F.expr(f"approx_top_k(__hash, {HEAVY_VISITS}, {TRACKED})").alias("top")).select(F.inline("top"))
        heavy = F.broadcast(counted.filter(F.col("count") > heavy_rows).select(F.col("item").alias("__hash"), F.lit(True).alias("__heavy")))  # HEAVY_VISITS rows at most
        # Rows are marked by one outer join, so that both ways can share the shuffles that made the rows; a semi or anti
        # join would be pushed below the caller's own joins, and each way would run those again.
        marked = rows.withColumn("__hash", hashed).join(heavy, "__hash", "left").drop("__hash")
        parts = [marked.filter("__heavy is null").drop("__heavy"), marked.filter("__heavy").drop("__heavy")]
    # One shuffle by the coarse key: its partitioning and sorting serve the finer windows too.
    parts = [whole(parts[0].repartition(col(facility), col(visit))), *map(whole, parts[1:])]
    by = (facility, visit)
    make = (_long(by), _long_heavy) if return_format == "long" else (_collapsed(by, columns, fields, merge_delimiter), _collapsed_heavy(columns, fields, merge_delimiter))
    out = [f(part).withColumn(".episode_id", episode_id(F.col("__key.facility"), F.col("__key.visit"))) for f, part in zip(make, parts)]
    shown = [*columns, "patient_class", ".episode_id", SEQUENCE, N_ROWS, INDEX]
    result = functools.reduce(DataFrame.unionByName, [df.select(*[col(c) for c in shown]) for df in out])
    return result.orderBy(col(".episode_id").asc_nulls_last()) if sort else result


def _timed_class(first: Column) -> Column:
    return F.struct(first.isNull().alias("untimed"), first.alias("time"), F.col("patient_class").alias("class"))


def _is_index() -> Column:
    return (F.col("patient_class") == "ED") | ((F.col("patient_class") != "ED") & (col(N_ROWS) == 1))


def _row_place() -> Column:
    return F.struct(F.col(SOURCE), F.col(ORDER), F.col(PLACE))


def _stays() -> Column:
    """What is least for the row of an episode that stays: its first emergency row, or else its first row."""
    return F.struct(F.coalesce(F.col("patient_class") != "ED", F.lit(True)), _row_place())


def _windowed(rows: DataFrame, by: tuple[str, str], more: dict[str, Column]) -> DataFrame:
    """Rows, dealt by facility and visit, with sequence and size of their episode, and with ``more`` figures of it."""
    episode, own_class = Window.partitionBy(*map(col, by)), Window.partitionBy(*map(col, by), col("patient_class"))
    rows = rows.withColumn("__first", F.min(col(TIME)).over(own_class))
    # One entry for each class, however many rows an episode has.
    classes = F.collect_set(_timed_class(F.col("__first"))).over(episode)
    return rows.withColumns({"__classes": classes, N_ROWS: F.count(F.lit(1)).over(episode), **{k: v.over(episode) for k, v in more.items()}}).withColumn(SEQUENCE, class_sequence(F.col("__classes")))


def _long(by: tuple[str, str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: _windowed(rows, by, {}).withColumn(INDEX, _is_index())


def _reconciled(fields: Mapping[str, str], delimiter: str, flags: Mapping[str, str], lists: Mapping[str, Column]) -> dict[str, Column]:
    """Columns of a collapsed episode, from the row that stays and lists of (class, value) in row order."""
    value = lambda c: merge.merged(fields[c], F.transform(lists[c], lambda r: r[_FIELD + c]), F.transform(lists[c], lambda r: r["class"]), col(c), delimiter)
    merged = {c: F.when(col(N_ROWS) > 1, value(c)).otherwise(col(c)) for c in fields if c not in flags}
    return {**merged, **{c: F.col(n) for c, n in flags.items()}, INDEX: F.lit(True)}


_FIELD = "field "


def _flags_of(columns: list[str]) -> dict[str, str]:
    return {c: f"__flag{i}" for i, c in enumerate(c for c in columns if c.startswith("has_been_"))}


def _collapsed(by: tuple[str, str], columns: list[str], fields: Mapping[str, str], delimiter: str) -> Callable[[DataFrame], DataFrame]:
    flags = _flags_of(columns)

    def collapse(rows: DataFrame) -> DataFrame:
        rows = _windowed(rows, by, {"__least": F.min(_stays()), **{n: F.max(col(c)) for c, n in flags.items()}})
        several = col(N_ROWS) > 1
        # Nulls are not gathered, so an episode of one row gathers nothing.
        entry = F.struct(_row_place().alias("at"), F.col("patient_class").alias("class"), *[col(c).alias(_FIELD + c) for c in fields])
        if fields:
            rows = rows.withColumn("__rows", F.collect_list(F.when(several, entry)).over(Window.partitionBy(*map(col, by))))
        rows = rows.filter(~several | (_stays() == F.col("__least")))
        if fields:
            rows = rows.withColumn("__rows", F.sort_array("__rows"))
        return rows.withColumns(_reconciled(fields, delimiter, flags, dict.fromkeys(fields, F.col("__rows"))))

    return collapse


def _heavy(rows: DataFrame, more: dict[str, Column], merged: dict[str, Column]) -> DataFrame:
    """Sequence and size of each episode: partial counts and first times by class, then one row each.

    ``more`` are figures of rows by class, ``merged`` those of classes by episode."""
    by_class = rows.groupBy("__key", "patient_class").agg(F.min(col(TIME)).alias("__first"), F.sum(F.lit(1) + _nought(rows)).alias("n"), *[v.alias(k) for k, v in more.items()])
    both = by_class.groupBy("__key").agg(F.collect_list(_timed_class(F.col("__first"))).alias("classes"), F.sum("n").alias(N_ROWS), *[v.alias(k) for k, v in merged.items()])
    return both.withColumn(SEQUENCE, class_sequence(F.col("classes"))).drop("classes")


def _long_heavy(rows: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(_heavy(rows, {}, {})), "__key").withColumn(INDEX, _is_index())  # HEAVY_VISITS rows at most


def _collapsed_heavy(columns: list[str], fields: Mapping[str, str], delimiter: str) -> Callable[[DataFrame], DataFrame]:
    flags, every = _flags_of(columns), [*columns, "patient_class"]

    def entries(rows: DataFrame) -> DataFrame:
        """Values that count, by visit, field and whether the row is an admission, each once, at its first place.

        A value that comes again changes no strategy's result."""
        counts = {"prefer_yes": lambda v: merge.affirmative(v), "prefer_admission": lambda v: merge.admits(F.col("patient_class")) & (v.cast("string") != "")}
        value = lambda c: F.when(counts.get(fields[c], lambda v: v.isNotNull())(col(c)), col(c))
        none = lambda c: F.lit(None).cast(rows.schema[c].dataType)
        each = F.array(*[F.struct((F.lit(i) + _nought(rows)).alias("field"), *[(value(c) if c == own else none(c)).alias(_FIELD + c) for c in fields]) for i, own in enumerate(fields)])
        named = [col(_FIELD + c) for c in fields]
        admitted = F.when(merge.admits(F.col("patient_class")), merge.ADMISSION[0]).alias("class")
        flat = rows.select("__key", _row_place().alias("at"), admitted, F.explode(each).alias("e")).select("__key", "at", "class", "e.*")
        return flat.filter(F.coalesce(*[n.cast("string") for n in named]).isNotNull()).groupBy("__key", "field", "class", *named).agg(F.min("at").alias("at"))

    def collapse(rows: DataFrame) -> DataFrame:
        row = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(every)])
        largest = {n: F.max(col(c)) for c, n in flags.items()}
        # Tasks send on one row for each visit and class they have.
        by_class = {"row": F.min_by(row, _stays()), "least": F.min(_stays()), **largest}
        out = _heavy(rows, by_class, {"row": F.min_by("row", "least"), **{n: F.max(n) for n in largest}})
        if fields:
            lists = []
            for i, (c, how) in enumerate(fields.items()):
                entry = F.when(F.col("field") == i, F.struct("at", "class", col(_FIELD + c)))
                # Of a preferred value only the first counts.
                lists.append((F.sort_array(F.collect_list(entry)) if not how.startswith("prefer") else F.filter(F.array(F.min(entry)), lambda e: e.isNotNull())).alias(f"__list{i}"))
            out = out.join(entries(rows).groupBy("__key").agg(*lists), "__key", "left")
        out = out.select("*", *[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(every)])
        # Without any value there is no list; the strategies take an empty one.
        some = {c: F.coalesce(F.col(f"__list{i}"), F.array()) for i, c in enumerate(fields)}
        return out.withColumns(_reconciled(fields, delimiter, flags, some))

    return collapse
