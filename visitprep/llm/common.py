"""Shared pieces of the document operators: table access, batching, word cutting and hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

# Sub-batches are cut at this many bytes of text, so that the numpy temporaries of one step stay
# bounded whatever the number of rows in an Arrow batch.  A longer text is a sub-batch of its own.
STEP_BYTES = 1 << 20

# Word separators of every word-based operator: space and \x09-\x0D (what bytes.split() splits on).
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII lower-casing only, as a byte translation.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_BASE = np.uint64(0x9E3779B97F4A7C55 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table by name; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of a frame.

    A column that has its name and type already is passed on as it is: an alias would keep Spark from
    seeing that two uses of the frame can share one shuffle.
    """
    ident = F.col(id_col) if id_col == "doc_id" and dict(docs.dtypes)[id_col] == "bigint" else F.col(id_col).cast("long").alias("doc_id")
    return docs.select(ident, F.col(text_col) if text_col == "text" else F.col(text_col).alias("text"))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df`` in bytes (file sizes for a scan); starts no job."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size.toString()) if hasattr(size, "toString") else int(size)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that all bits of a polynomial hash can be used."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0..n of the hash base modulo 2**64, kept between calls."""
    key = "inverse" if inverse else "base"
    if key not in _POWERS or len(_POWERS[key]) <= n:
        size = max(n + 1, STEP_BYTES)
        steps = np.full(size, _INV if inverse else _BASE, dtype=np.uint64)
        steps[0] = 1
        _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS[key][: n + 1]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i (uint64, n + 1 entries) for ``span_hash``."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(len(values))[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] that does not depend on the place."""
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * _powers(len(prefix) - 1, inverse=True)[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-separator bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SEPARATOR[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_MASKS = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(9)], np.uint64)


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at ``starts`` to ``ends``, eight bytes at a step.

    Every step is a bijection of the state mixed with the bytes, not a polynomial, so texts of a regular
    structure do not collide.  Words beyond 64 bytes are hashed by a digest.
    """
    sizes = ends - starts
    flat = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), 0, (1,))
    with np.errstate(over="ignore"):
        out = mix((flat[starts] & _MASKS[np.minimum(sizes, 8)]) ^ mix(sizes.astype(np.uint64) + _BASE))
        at = np.flatnonzero((sizes > 8) & (sizes <= 64))
        step = 8
        while len(at):
            out[at] = mix(out[at] * _BASE ^ (flat[starts[at] + step] & _MASKS[np.minimum(sizes[at] - step, 8)]))
            step += 8
            at = at[sizes[at] > step]
    for i in np.flatnonzero(sizes > 64).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def steps(sizes: list[int], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows with at most ``limit`` bytes each, one row at least."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if sizes:
        yield first, len(sizes)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column with nulls as empty strings."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def pieces(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``STEP_BYTES`` of a text column, so that few of its texts are Python's at a time."""
    sizes = pc.fill_null(pc.binary_length(column(batch, name)), 0).to_pylist()
    for a, b in steps(sizes):
        yield batch.slice(a, b - a)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, nulls as empty; no decoding to str."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def kept_columns(keep: list[str], made: Iterable[str]) -> list[str]:
    """``keep``, unless it repeats a name or has one of a column that the operator makes."""
    if clash := sorted({c for c in keep if keep.count(c) > 1} | (set(keep) & set(made))):
        raise ValueError(f"kept columns clash with each other or with columns made here: {', '.join(clash)}; rename them first")
    return keep


def free_name(stem: str, names: Iterable[str]) -> str:
    """``stem`` with as many underscores as make it differ from all ``names``, in whatever case."""
    taken = {n.lower() for n in names}
    while stem.lower() in taken:
        stem += "_"
    return stem


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    One is set only where none is and the master is local, as in tests: on a cluster a folder that only
    one machine sees would lose tables.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = "/tmp/checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"


_HELD: dict[str, object] = {}


def hold(name: str, make: Callable[[], T]) -> T:
    """A model that a worker keeps between tasks; one at a time, so that stages do not add up in memory."""
    if name not in _HELD:
        if _HELD:
            _HELD.clear()
            trim()  # what the last model took is not kept beside the next one
        _HELD[name] = make()
    return _HELD[name]


_SCRATCH: list[list[tuple[SparkSession, str]]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables written within, unless kept, are removed at the end."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for spark, path in _SCRATCH.pop():
            delete(spark, path)


def written(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends, and lost executors lose nothing."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table's files, in whatever store they are."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    for df in frames:
        delete(df.sparkSession, df.table_path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs, which it does once the driver's JVM has
    collected the plans that refer to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give freed memory of this process back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


#: Bytes of a group's table from which a worker gives memory back when it is done with it.
LARGE_GROUP = 4 << 20


def trimmed(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``f`` for groups, whose temporary memory does not stay with the worker while it waits for others."""

    @functools.wraps(f)
    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        if table.nbytes >= LARGE_GROUP:
            trim()
        return out

    return run


def trimmed_task(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for batches, whose temporary memory does not stay with the worker after its task."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        trim()

    return run
