import datetime as dt

import pytest
from pyspark.sql import functions as F

from visitprep.functions import merge
from visitprep.functions.timestamps import parse_timestamp, parse_updates
from visitprep.operators import link_encounters
from visitprep.operators.episodes import split_classes

MERGED = "CCDD string, CCDDCategory_flat string, C_Death string, Discharge_Disposition string, DispositionCategory string"
PULL = f"HospitalName string, Visit_ID string, HasBeenE int, HasBeenAdmitted int, C_Visit_Date_Time timestamp, {MERGED}"
ED = ("H", "V1", 1, 0, dt.datetime(2023, 1, 1, 8), "ear ache|E01.1", "Ear;Ache", "No", "Went home", "Left")
DA = ("H", "V1", 0, 1, dt.datetime(2023, 1, 1, 14), "burnt hand|B07.3", "Burn;Hand", "Yes", "Moved to ward", "Warded")


def pulls(spark):
    return spark.createDataFrame([ED], PULL), spark.createDataFrame([DA], PULL)


def test_two_pulls_merge(spark):
    (r,) = link_encounters(*pulls(spark)).collect()
    assert r.ccdd == "ear ache;burnt hand|E01.1;B07.3"
    assert r.ccdd_category_flat == "Ear;Ache;Burn;Hand"
    assert (r.c_death, r.discharge_disposition, r.disposition_category) == ("Yes", "Moved to ward", "Warded")
    assert (r.patient_class, r[".patient_class_sequence"], r[".episode_n_rows"], r[".index_encounter"]) == ("ED", "ED->Direct Admit", 2, True)
    # The emergency side's flags are used up, so only the inpatient side's are left.
    assert (r.has_been_e, r.has_been_admitted) == (0, 1)
    kept = link_encounters(*pulls(spark), keep_flags=True).first()
    assert (kept.has_been_e, kept.has_been_admitted) == (1, 1)


def test_concat_and_single_rows(spark):
    ed, da = pulls(spark)
    assert link_encounters(ed, da, merge_fields={"C_Death": "concat"}).first().c_death == "No; Yes"
    alone = link_encounters(ed, merge_fields={"CCDDCategory_flat": "union_delimited"}).first()
    assert alone.ccdd_category_flat == "Ear;Ache" and alone[".patient_class_sequence"] == "ED"


def test_flag_mode(spark):
    schema = "HospitalName string, Visit_ID string, HasBeenE int, HasBeenAdmitted int, HasBeenI int, HasBeenO int"
    df = spark.createDataFrame([("A", "1", 1, 1, 1, None), ("A", "2", 0, 0, 0, 0), ("A", "3", None, 1, 0, 1)], schema)
    with pytest.warns(UserWarning, match="no column gives a time"):
        rows = link_encounters(df, return_format="long").collect()
    assert sorted((r.visit_id, r.patient_class) for r in rows) == [("1", "Admitted"), ("1", "ED"), ("3", "Admitted"), ("3", "Outpatient")]
    assert all(r[".index_encounter"] == (r.patient_class == "ED") for r in rows)
    assert not any(c.startswith("has_been") for c in rows[0].asDict())
    with pytest.warns(UserWarning, match="outpatient"):
        link_encounters(df, diagnostics_mode="eager")


def test_class_lists(spark):
    schema = "HospitalName string, Visit_ID string, C_Patient_Class_List string, C_Patient_Class_MDT_Updates string"
    rows = [
        ("A", "1", "EI", "{1};2023-01-01 10:00:00;|{2};2023-01-01 08:00:00;|"),
        ("A", "2", "Emergency, Inpatient,", None),
        ("A", "3", None, None),
        ("A", "4", "EEX", "free text"),
        ("A_B", "C", "I", None),
        ("A", "B_C", "D", None),
        (None, None, "ID", None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {}
    for r in link_encounters(df, return_format="long").collect():
        got.setdefault(r.visit_id, []).append(r)
    sequences = {k: v[0][".patient_class_sequence"] for k, v in got.items()}
    assert sequences == {"1": "Inpatient->ED", "2": "ED->Inpatient", "3": None, "4": "ED->X", "C": "Inpatient", "B_C": "Direct Admit", None: "Direct Admit->Inpatient"}
    assert [len(got[k]) for k in ("1", "2", "3", "4")] == [2, 2, 1, 3]
    assert not any(r[".index_encounter"] for r in got[None])
    assert got[None][0][".episode_id"] == "NA_NA"
    collapsed = link_encounters(df, sort=True).collect()
    # Ids that read alike stay apart.
    assert len(collapsed) == 7 and [r[".episode_id"] for r in collapsed].count("A_B_C") == 2
    with pytest.warns(UserWarning) as told:
        link_encounters(df, diagnostics_mode="eager")
    assert {"no class list" in str(w.message) for w in told} == {True, False}


def test_date_and_time(spark):
    schema = "HospitalName string, Visit_ID string, HasBeenE int, HasBeenAdmitted int, Date date, Time string"
    day = dt.date(2023, 1, 2)
    df = spark.createDataFrame([("A", "1", 1, 0, day, "10:30:00"), ("A", "1", 0, 1, day, "09:00:00"), ("A", "2", 0, 1, day, None)], schema)
    assert {r.visit_id: r[".patient_class_sequence"] for r in link_encounters(df).collect()} == {"1": "Admitted->ED", "2": "Admitted"}


def test_inpatient_nulls(spark):
    ed, _ = pulls(spark)
    rows = [("H", f"V{i}", flag, 1, dt.datetime(2023, 1, 1), *DA[5:]) for i, flag in ((2, None), (3, 0))]
    # Rows with a null flag stay unless another row says that the pull holds emergency visits.
    assert link_encounters(ed, spark.createDataFrame(rows, PULL)).count() == 3
    assert link_encounters(ed, spark.createDataFrame([*rows, ("H", "V4", 1, *DA[3:])], PULL)).count() == 2


def test_errors(spark):
    ed, da = pulls(spark)
    with pytest.raises(ValueError, match="strateg"):
        link_encounters(ed, merge_fields={"CCDD": "longest"})
    with pytest.raises(ValueError, match="HasBeenE"):
        link_encounters(ed.drop("HasBeenE"))
    with pytest.raises(ValueError, match="HasBeenAdmitted"):
        link_encounters(ed.drop("HasBeenAdmitted"))
    with pytest.raises(ValueError, match="patient_class"):
        link_encounters(ed.withColumn("patient_class", F.lit("x")))
    with pytest.raises(ValueError, match="differ in type"):
        link_encounters(ed, da.withColumn("CCDD", F.lit(1)))
    assert link_encounters(ed.limit(0), da.limit(0)).count() == 0


def test_order_does_not_depend_on_partitions(spark):
    schema = "HospitalName string, Visit_ID string, seq int, C_Patient_Class_List string, note string"
    rows = [("A", "1", i, "I", f"n{i}") for i in range(6)]
    for n in (1, 5):
        df = spark.createDataFrame(rows[::-1], schema).repartition(n)
        r = link_encounters(df, order_key=["seq"], merge_fields={"note": "concat"}).first()
        assert r.seq == 0 and r.note == "n0; n1; n2; n3; n4; n5"


def test_one_shuffle(spark):
    ed, da = pulls(spark)
    plan = link_encounters(ed, da.drop("HasBeenE"), heavy_rows=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


@pytest.mark.parametrize(
    ("text", "time"),
    [
        ("2023-01-15T08:05:09", (2023, 1, 15, 8, 5, 9)),
        ("2023-01-15 08:05:09.25Z", (2023, 1, 15, 8, 5, 9, 250000)),
        ("2023-1-5T8:05", (2023, 1, 5, 8, 5)),
        (" 2023-01-15 08:05 ", (2023, 1, 15, 8, 5)),
        ("2023-01-15", (2023, 1, 15)),
        ("01/15/2023 08:00:01", (2023, 1, 15, 8, 0, 1)),
        ("01/15/2023 08:00", (2023, 1, 15, 8)),
        ("1/15/2023", (2023, 1, 15)),
        ("2023-01-01 08:00:00 EST", (2023, 1, 1, 8)),
        ("2023-01-01 junk", (2023, 1, 1)),
        ("2023-01-01 NA", (2023, 1, 1)),
        ("2023-02-30", None),
        ("junk", None),
        ("", None),
        (None, None),
    ],
)
def test_timestamps(spark, text, time):
    got = spark.createDataFrame([(text,)], "t string").select(parse_timestamp(F.col("t")).alias("t")).first().t
    assert got == (dt.datetime(*time) if time else None)


@pytest.mark.parametrize(
    ("updates", "n", "times"),
    [("{1};a;|{2};b;|", 2, ["a", "b"]), ("{2} ; b c ;|{2};d", 3, [None, "d", None]), ("{9};x;|{0};y;|junk", 1, [None]), (None, 2, [None, None]), ("", 1, [None])],
)
def test_updates(spark, updates, n, times):
    assert spark.createDataFrame([(updates,)], "u string").select(parse_updates(F.col("u"), F.lit(n)).alias("u")).first().u == times


@pytest.mark.parametrize(("text", "codes"), [("EI", ["E", "I"]), ("EE", ["E", "E"]), ("E,", ["E"]), ("Emergency,Direct Admit", ["Emergency", "Direct Admit"]), ("", [None]), (None, [None])])
def test_split_classes(spark, text, codes):
    assert spark.createDataFrame([(text,)], "c string").select(split_classes(F.col("c")).alias("c")).first().c == codes


@pytest.mark.parametrize(
    ("strategy", "values", "classes", "result"),
    [
        ("concat", ["ab", "b", "c"], None, "ab; c"),
        ("concat", [None, "", "x"], None, "x"),
        ("concat", [None, ""], None, None),
        ("union_delimited", ["a; b", "b;c", None], None, "a;b;c"),
        ("union_delimited", [";", ";;"], None, ""),
        ("union_delimited", [None, ""], None, None),
        ("union_ccdd", ["a|x|z", "b;a|y", "c"], None, "a;b;c|x;y"),
        ("union_ccdd", ["|", "|"], None, "|"),
        ("prefer_yes", ["No", "YES", "1"], None, "YES"),
        ("prefer_yes", ["No", None], None, "No"),
        ("prefer_admission", ["home", "", "ward"], ["ED", "Inpatient", "Admitted"], "ward"),
        ("prefer_admission", ["home", "x"], ["ED", "Observation"], "home"),
    ],
)
def test_strategies(spark, strategy, values, classes, result):
    df = spark.createDataFrame([(values, classes or ["ED"] * len(values), values[0])], "v array<string>, c array<string>, p string")
    assert df.select(merge.merged(strategy, F.col("v"), F.col("c"), F.col("p"), ";").alias("x")).first().x == result


def test_other_delimiters(spark):
    df = spark.createDataFrame([(["a|b", "b|c"],)], "v array<string>")
    assert df.select(merge.union_delimited(F.col("v"), "|").alias("x")).first().x == "a|b|c"


def test_names_are_snake_case_either_way(spark):
    assert link_encounters(*pulls(spark), clean_names=False).columns == link_encounters(*pulls(spark)).columns


ODD = "HospitalName string, Visit_ID string, HasBeenE int, HasBeenAdmitted int, HasBeenX int, C_Visit_Date_Time timestamp, n int, CCDD string, CCDDCategory_flat string, C_Death string, Discharge_Disposition string, DispositionCategory int"


def odd_rows(n, seed):
    import random

    rng = random.Random(seed)
    some = lambda *values: rng.choice([None, "", *values])
    return [
        (rng.choice(["A", "B", None]), rng.choice(["0", "V1", "V2", f"V{i}", None]), rng.choice([0, 1, 1, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), rng.choice([None, dt.datetime(2023, 1, 1 + i % 9)]), i,
         some("a;b|X;Y", "b;c|Y", "d|", "e|Z|more"), some("x;y", " y ;z", "w;;x"), some("No", "yes", "YES", "1"), some("home", "ward", "home again"), rng.choice([None, 1, 2, 3]))
        for i in range(n)
    ]


ALL_STRATEGIES = ["concat", "union_delimited", "union_ccdd", "prefer_yes", "prefer_admission"]


@pytest.mark.parametrize("turn", range(5))
def test_visits_of_many_rows_are_linked_alike(spark, turn):
    """The way of heavy visits gives what the windows give, for every strategy on every field."""
    ed, da = (spark.createDataFrame(odd_rows(150, seed), ODD).repartition(3) for seed in (turn, turn + 50))
    fields = {c: ALL_STRATEGIES[(i + turn) % 5] for i, c in enumerate(["CCDD", "CCDDCategory_flat", "C_Death", "Discharge_Disposition"])}
    fields["DispositionCategory"] = ["prefer_admission", "prefer_yes"][turn % 2]
    for how in ("long", "collapsed"):
        plain, all_heavy, some_heavy = ([repr(r) for r in link_encounters(ed, da, merge_fields=fields, return_format=how, order_key=["n"], heavy_rows=h, keep_flags=True).collect()] for h in (None, 0, 8))
        assert sorted(plain) == sorted(all_heavy) == sorted(some_heavy) and plain


def test_class_lists_of_many_rows(spark):
    rows = [("A", "0", c, i) for i, c in enumerate(["EI", None, "", "Emergency, Odd one", "ZE", "D"] * 3)] + [(None, None, "I", 50), (None, None, "E", 51)]
    df = spark.createDataFrame(rows, "HospitalName string, Visit_ID string, C_Patient_Class_List string, n int")
    got = [sorted(repr(r) for r in link_encounters(df, return_format="long", order_key=["n"], heavy_rows=h).collect()) for h in (None, 1)]
    assert got[0] == got[1] and any("'Direct Admit->ED->Inpatient->Odd one->Z'" in r for r in got[0])


def shuffled_rows(df):
    """Rows that each shuffle of an executed plan wrote."""
    plan, found, todo = df._jdf.queryExecution().executedPlan(), [], []
    todo.append(plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") and "Adaptive" in plan.nodeName() else plan)
    while todo:
        node = todo.pop()
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        if node.nodeName() == "Exchange":
            found.append(node.metrics().get("shuffleRecordsWritten").get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.fixture
def uncoalesced(spark):
    """Small partitions stay, 16 of each shuffle, so that they can be compared."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_placeholder_visit_is_no_one_task(uncoalesced):
    """One visit has 30 % of the rows; no task has over twice the median."""
    spark, n = uncoalesced, 60_000
    df = spark.range(n, numPartitions=8).selectExpr(
        "'H' as HospitalName", "if(id % 10 < 3, '0', cast(id as string)) as Visit_ID", "1 as HasBeenE", "cast(id % 7 = 0 as int) as HasBeenAdmitted",
        "timestamp_seconds(id) as C_Visit_Date_Time", "concat('d', id % 5) as Discharge_Disposition", "id as n",
    )
    args = {"order_key": ["n"], "heavy_rows": 5_000, "merge_fields": {"Discharge_Disposition": "concat"}}
    long = link_encounters(df, return_format="long", **args)
    sizes = sorted(r["count"] for r in long.groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2] and sum(sizes) == n + len(range(0, n, 7))
    collapsed = link_encounters(df, **args)
    rows = collapsed.filter("visit_id = '0'").collect()
    assert len(rows) == 1 and rows[0].discharge_disposition == "d0; d1; d2" and rows[0][".episode_n_rows"] == len([i for i in range(n) if i % 10 < 3]) + len([i for i in range(0, n, 7) if i % 10 < 3])
    collapsed.collect()
    wrote = sorted(shuffled_rows(collapsed))
    light = len([i for i in range(n) if i % 10 >= 3]) + len([i for i in range(0, n, 7) if i % 10 >= 3])
    # Two shuffles have the light visits: their rows, and the count by visit with a row from each task for the heavy one.
    assert light in wrote and all(w < 200 for w in wrote if not light <= w <= light + 8 and w != n - n * 3 // 10 + 8), wrote


def test_figures_share_the_shuffles_of_the_rows(spark):
    """Lines are read once for each pull, whatever is counted of them beside the rows."""
    from visitprep.plans import registry

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for name in ("merge_ccdd", "link_long_two_pull"):
            plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan parquet [l_orderkey") == 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_flagged_inpatient_rows_and_counts_of_light_visits_do_not_travel(uncoalesced):
    """Of 3,000 inpatient rows joined by their caller, the 2,000 flagged ones leave before that join; no count has a row for each visit."""
    spark = uncoalesced
    ed = spark.range(1_000, numPartitions=4).selectExpr("'H' as HospitalName", "cast(id as string) as Visit_ID", "1 as HasBeenE", "0 as HasBeenAdmitted", "timestamp_seconds(id) as C_Visit_Date_Time", "id as n")
    lines = spark.range(3_000, numPartitions=4).selectExpr("id as k", "if(id % 3 = 0, 'R', 'A') as kind")
    names = spark.range(5_000, numPartitions=4).selectExpr("id as k", "id + 7 as n")
    da = lines.join(names.hint("merge"), "k").selectExpr("'H' as HospitalName", "cast(k as string) as Visit_ID", "case when kind = 'A' then 1 else 0 end as HasBeenE", "timestamp_seconds(k) as C_Visit_Date_Time", "n")
    out = link_encounters(ed, da, return_format="long", order_key=["n"])
    assert len(out.collect()) == 2_000
    wrote = sorted(shuffled_rows(out))
    # The inpatient lines that stay, the names that can meet them, and all rows by visit; all else is a row from each task or so.
    assert [w for w in wrote if w > 100] == [1_000, 1_667, 2_000], wrote


@pytest.mark.parametrize(("flags", "stay"), [((1, 0, None, 2), {1}), ((0, None, 2), {0, 1, 2}), ((1,), set()), ((), set())])
def test_inpatient_rows_of_unclear_flags_stay_only_without_flagged_ones(spark, flags, stay):
    ed = spark.createDataFrame([("H", "v", 1, 0)], "HospitalName string, Visit_ID string, HasBeenE int, HasBeenAdmitted int")
    da = spark.createDataFrame([("H", f"w{i}", f) for i, f in enumerate(flags)], "HospitalName string, Visit_ID string, HasBeenE int")
    for heavy in (None, 0):
        out = link_encounters(ed, da, return_format="long", diagnostics_mode="off", heavy_rows=heavy)
        assert {r.visit_id for r in out.collect()} == {"v"} | {f"w{i}" for i in stay}
