"""Bringing equal 64-bit fingerprints of different documents together in compact form.

A task packs the fingerprints of a batch of documents into one row for each bucket, six bytes for each
fingerprint (the bucket holds further bits).  Two different fingerprints may so be taken for one;
users of this exchange verify what it finds, so that costs time and never a result.  The number of
buckets follows the size of the input, so that a bucket has a bounded number of fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Bytes of input for each bucket.
BUCKET_BYTES = 2 << 20
LOW = np.uint64((1 << 48) - 1)

#: Fingerprints of a run of documents: ids of the documents, number of fingerprints of each, all of them.
Prints = tuple[np.ndarray, np.ndarray, np.ndarray]


def buckets(docs: DataFrame) -> int:
    return int(max(4 * common.shuffle_partitions(docs), -(-common.input_bytes(docs) // BUCKET_BYTES)))


def packed(prints: Prints, n_buckets: int) -> pa.RecordBatch:
    """One row for each bucket: its fingerprints by document, and the documents."""
    ids, counts, values = prints
    bucket = ((values >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    owner = np.repeat(np.arange(len(ids)), counts)[order]
    values, bucket = values[order], bucket[order].astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows: tuple[list, ...] = ([], [], [], [])
    for a, b in zip(edges, np.append(edges, len(bucket))[1:], strict=True):
        own, times = np.unique(owner[a:b], return_counts=True)
        rows[0].append(int(bucket[a]))
        rows[1].append((values[a:b] & LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
        rows[2].append(times.astype("<u4").tobytes())
        rows[3].append(ids[own].astype("<i8").tobytes())
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["bucket", "prints", "times", "ids"])


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All fingerprints of a bucket's rows, and the document of each."""
    values, ids = [], []
    for prints, times, own in zip(*(table.column(c).to_pylist() for c in ("prints", "times", "ids")), strict=True):
        wide = np.zeros((len(prints) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(prints, np.uint8).reshape(-1, 6)
        values.append(wide.view("<u8").reshape(-1))
        ids.append(np.repeat(np.frombuffer(own, "<i8"), np.frombuffer(times, "<u4")))
    return np.concatenate(values), np.concatenate(ids)


def grouped(docs: DataFrame, prints_of: Callable[[pa.RecordBatch], Iterator[Prints]], reduce: Callable[[int, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``reduce(bucket, fingerprints, documents)`` over every bucket of the fingerprints of ``docs``."""
    n = buckets(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for prints in prints_of(batch):
                if len(prints[2]):
                    yield packed(prints, n)

    def merge(table: pa.Table) -> pa.Table:
        return reduce(table.column("bucket")[0].as_py(), *unpacked(table))

    return docs.mapInArrow(run, "bucket long, prints binary, times binary, ids binary").groupBy("bucket").applyInArrow(merge, schema)
