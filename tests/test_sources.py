import datetime as dt

from visitprep.operators import classify_duplicates, summarize_duplicates
from visitprep.sources.schema import VISITS, cleaned_visits, synthetic_visits
from visitprep.streaming.latest import keep_latest, latest


def test_synthetic_tables(spark):
    raw = synthetic_visits(spark)
    assert raw.columns == VISITS.fieldNames() and len(raw.columns) == 18 and raw.count() == 193
    t = summarize_duplicates(raw).overall.first()
    assert (t.n_unique_visits, t.n_excess_rows) == (180, 13)
    kinds = {r.dup_type: r.n for r in classify_duplicates(raw).overall.collect()}
    assert kinds == {"type_unknown": 5, "visit_date_change": 3, "pid_change": 2, "visit_date_change+pid_change": 1, "patient_class_change": 2}
    clean = cleaned_visits(spark)
    assert clean.count() == 160 and len(clean.columns) == 21


def test_stream_keeps_the_latest(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "HospitalName string, Visit_ID string, at timestamp, note string"
    batches = [[("A", "1", dt.datetime(2023, 1, 1), "old"), ("A", "2", dt.datetime(2023, 1, 1), "only")], [("A", "1", dt.datetime(2023, 1, 3), "new"), ("B", "1", dt.datetime(2023, 1, 2), "other")], [("A", "1", dt.datetime(2023, 1, 2), "late")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        keep_latest(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "log"), order_by="at").awaitTermination()
    assert sorted((r.hospital_name, r.visit_id, r.note) for r in latest(spark, target).collect()) == [("A", "1", "new"), ("A", "2", "only"), ("B", "1", "other")]


def test_a_batch_rewrites_only_its_parts(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "HospitalName string, Visit_ID string, at timestamp, note int"
    want = {}
    for turn in range(4):
        rows = [("A", str(i), dt.datetime(2023, 1, 1 + turn), turn) for i in (range(300) if turn == 0 else range(turn, turn + 2))]
        want |= {r[1]: r[3] for r in rows}
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        keep_latest(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "log"), order_by="at", buckets=64).awaitTermination()
    assert {r.visit_id: r.note for r in latest(spark, target).collect()} == want
    parts = sorted((p.parent.name, p.name) for p in (tmp_path / "table").glob("batch=*/__bucket=*"))
    assert all(sum(b == f"batch={n}" for b, _ in parts) <= 2 for n in (1, 2, 3))
    # At most two versions of a part are left: the newest, and the one a new run of its batch would read.
    names = [name for _, name in parts]
    assert max(names.count(n) for n in names) <= 2


def test_a_batch_run_again_gives_the_same(spark, tmp_path):
    import shutil

    source, target, log = str(tmp_path / "in"), str(tmp_path / "table"), tmp_path / "log"
    schema = "HospitalName string, Visit_ID string, at timestamp, note int"
    for turn in range(3):
        spark.createDataFrame([("A", "1", dt.datetime(2023, 1, 1 + turn), turn), (None, None, None, turn)], schema).coalesce(1).write.mode("append").parquet(source)
        keep_latest(spark.readStream.schema(schema).parquet(source), target, str(log), order_by="at", buckets=2).awaitTermination()
    first = sorted(map(repr, latest(spark, target).collect()))
    for kind in ("commits",):  # as if the last batch had failed after its write
        for f in (log / kind).glob("*2*"):
            f.unlink()
    keep_latest(spark.readStream.schema(schema).parquet(source), target, str(log), order_by="at", buckets=2).awaitTermination()
    assert sorted(map(repr, latest(spark, target).collect())) == first and len(first) == 2
    shutil.rmtree(target)
    assert latest(spark, target) is None
