"""The latest transmission of each visit, kept up to date from a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import col, resolve
from ..operators import dedupe

#: Parts of a kept table, by hash of facility and visit.
BUCKETS = 256
BUCKET = "__bucket"


def keep_latest(stream: DataFrame, target: str, checkpoint: str, *, order_by: str, order_key: Sequence[str] | None = None, facility_col: str = "HospitalName", visit_col: str = "Visit_ID", available_now: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Start a query that keeps one row for each facility and visit, the last by ``order_by``.

    The table is in ``buckets`` parts by facility and visit.  A batch rewrites the parts that its visits
    belong to, under ``target/batch=N``; the others stay in the batches that wrote them, and ``latest``
    reads the newest of each.  A batch that is run again after a failure finds the same predecessors, so
    it writes the same again: of each part the newest version before the batch is left until a later
    batch has replaced it.  A table keeps the number of parts it began with.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn(BUCKET, F.pmod(F.xxhash64(col(resolve(batch, facility_col)), col(resolve(batch, visit_col))), F.lit(buckets)).cast("int")).persist()
        try:
            parts = _parts(spark, target, below=number)
            touched = {r[0] for r in batch.select(BUCKET).distinct().collect()}  # as many as buckets
            before = _read(spark, target, {b: n for b, n in parts.items() if b in touched})
            rows = batch if before is None else before.unionByName(batch.select(*[F.col(c).alias(n) for c, n in zip(batch.columns, before.columns, strict=True)]))
            kept = dedupe(rows, facility_col=facility_col, visit_col=visit_col, keep="last", order_by=order_by, order_key=order_key or [order_by])
            kept = kept.withColumnRenamed(kept.columns[-1], BUCKET)
            kept.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{target}/batch={number}")
        finally:
            batch.unpersist()
        _forget(spark, target, parts, number)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _files(spark: SparkSession, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(target).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, target: str, below: float) -> dict[int, list[int]]:
    """Numbers of the complete batches that wrote each part, the oldest first."""
    files, path = _files(spark, target)
    found: dict[int, list[int]] = {}
    if files.exists(path(target)):
        names = [s.getPath().getName() for s in files.listStatus(path(target))]
        numbers = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
        for n in numbers:
            if n < below and files.exists(path(f"{target}/batch={n}/_SUCCESS")):
                for s in files.listStatus(path(f"{target}/batch={n}")):
                    if (name := s.getPath().getName()).startswith(f"{BUCKET}="):
                        found.setdefault(int(name.removeprefix(f"{BUCKET}=")), []).append(n)
    return found


def _parts(spark: SparkSession, target: str, below: float) -> dict[int, int]:
    """The batch with the newest version of each part."""
    return {b: numbers[-1] for b, numbers in _versions(spark, target, below).items()}


def _read(spark: SparkSession, target: str, parts: dict[int, int]) -> DataFrame | None:
    paths = [f"{target}/batch={n}/{BUCKET}={b}" for b, n in sorted(parts.items())]
    if not paths:
        return None
    rows = spark.read.option("basePath", target).parquet(*paths)
    return rows.select(*[col(c) for c in rows.columns if c not in ("batch", BUCKET)], BUCKET)


def _forget(spark: SparkSession, target: str, before: dict[int, int], number: int) -> None:
    """Remove versions older than the newest one before batch ``number``, which a new run of it would read."""
    files, path = _files(spark, target)
    for b, numbers in _versions(spark, target, below=number).items():
        for n in numbers:
            if n < before.get(b, n):
                files.delete(path(f"{target}/batch={n}/{BUCKET}={b}"), True)


def latest(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest complete version of every part of a table that ``keep_latest`` maintains."""
    rows = _read(spark, target, _parts(spark, target, float("inf")))
    return None if rows is None else rows.drop(BUCKET)
