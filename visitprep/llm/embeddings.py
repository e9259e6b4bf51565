"""Near-duplicate embeddings by lattice hashing.

Each of several tables projects a unit vector at random onto a few eight-dimensional spaces and takes
the nearest point of the E8 lattice in each: the points together are the vector's cell.  A vector is
filed under its own cell and looked up there and in neighbouring cells, in which one of its lattice
points is replaced by the next nearest.  Vectors that meet are verified by cosine in double precision.

Equal vectors are one node with a count.  A cell's lookups are compared with its filed vectors inside
tasks, in blocks, by matrix products; no pair leaves a task.  A pair that meets in several places
counts only in the first, which both vectors' cell lists tell.  Tasks return sums for each vector, and
for the components a spanning forest of their links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph

COSINE = 0.98
TABLES, SPACES, SCALE, SEED = 8, 2, 0.26, 5
#: Lookups of each vector in each table: its own cell, and one neighbour for each space.
PROBES = 1 + SPACES
#: Vectors filed under a cell, and lookups of it, that one call compares; and lookups of one product.
BLOCK, TURN, STEP = 2048, 8192, 512
#: Linked pairs that are kept before a forest replaces them.
PAIRS = 1 << 20


def planes(dim: int) -> np.ndarray:
    """Orthonormal projections of each table onto all its spaces (tables x dim x 8 * spaces)."""
    rng = np.random.default_rng([SEED, dim])
    width = 8 * SPACES
    out = np.empty((TABLES, dim, width))
    for t in range(TABLES):
        q, _ = np.linalg.qr(rng.standard_normal((max(dim, width), width)))
        out[t] = q[:dim] * np.sqrt(max(dim, width) / 64)
    return out


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    gap = x[odd] - near[odd]
    at = np.abs(gap).argmax(axis=1)
    near[odd, at] += np.where(gap[np.arange(len(odd)), at] >= 0, 1, -1)
    return near


def e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, doubled so that they are integers."""
    whole = _d8(x)
    half = _d8(x - 0.5) + 0.5
    better = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(better[:, None], 2 * half, 2 * whole).astype(np.int64)


def e8_next(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """A neighbouring point: the nearest after a step past ``point``, away from it towards x."""
    gap = x - point / 2
    norm = np.maximum(np.linalg.norm(gap, axis=1, keepdims=True), 1e-12)
    out = e8(x + gap * (0.6 / norm))
    for far in (1.0, 1.5, 2.0):
        same = (out == point).all(axis=1)
        if not same.any():
            break
        out[same] = e8(x[same] + gap[same] * (far / norm[same]))
    return out


def cells(unit: np.ndarray) -> np.ndarray:
    """Hashed cells (vectors x tables x probes); probe 0 is the vector's own."""
    project, n = planes(unit.shape[1]), len(unit)
    weights = np.random.default_rng(SEED).integers(1, 1 << 62, (SPACES, 8)).astype(np.uint64) | np.uint64(1)
    out = np.empty((n, TABLES, PROBES), np.int64)
    with np.errstate(over="ignore"):
        for t in range(TABLES):
            # einsum sums each row alike whatever the batch, so a vector has the same cells in every run.
            x = (np.einsum("nd,dk->nk", unit, project[t]) / SCALE).reshape(n, SPACES, 8)
            own = np.stack([e8(x[:, s]) for s in range(SPACES)], axis=1)
            other = np.stack([e8_next(x[:, s], own[:, s]) for s in range(SPACES)], axis=1)
            key = lambda p, s: common.mix((p.astype(np.uint64) * weights[s]).sum(axis=1))
            mine = [key(own[:, s], s) for s in range(SPACES)]
            total = sum(mine[1:], mine[0]) + np.uint64(t)
            out[:, t, 0] = common.mix(total).view(np.int64)
            for s in range(SPACES):
                out[:, t, 1 + s] = common.mix(total - mine[s] + key(other[:, s], s)).view(np.int64)
    return out


def _raw(column: pa.Array, dtype: str) -> tuple[np.ndarray, list[bytes]]:
    """Rows with a usable vector, and these vectors' bytes (minus zero as zero)."""
    rows, out = [], []
    for i, v in enumerate(column.to_pylist()):
        if v and None not in v:
            x = np.asarray(v, dtype) + 0
            if np.isfinite(x).all() and x.any():
                rows.append(i)
                out.append(x.tobytes())
    return np.array(rows, np.int64), out


def _units(raw: list[bytes], dtype: str) -> np.ndarray:
    """Vectors of one length at unit length, in double precision."""
    x = np.stack([np.frombuffer(r, dtype) for r in raw]).astype(np.float64)
    # Divided by the largest component first, so that extreme scales neither vanish nor overflow.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nodes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, dtype: str) -> DataFrame:
    """(vec_id, label, raw): usable vectors with a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, raw = _raw(common.column(batch, "embedding"), dtype)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([common.column(batch, "vec_id").take(at), common.column(batch, "label").take(at), pa.array(raw, pa.binary())], names=["vec_id", "label", "raw"])

    given = vectors.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    return given.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("embedding")).mapInArrow(run, "vec_id long, label string, raw binary")


FILED = "label string, cell long, width int, filed boolean, node long, n long, raw binary, cells binary, place int"


def _filed(distinct: DataFrame, dtype: str) -> DataFrame:
    """Each node filed under its own cell of each table, and looked up there and next to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = common.column(batch, "raw").to_pylist()
            node, label, n = (common.column(batch, c).to_pylist() for c in ("node", "label", "n"))
            out: tuple[list, ...] = tuple([] for _ in range(9))
            by_width: dict[int, list[int]] = {}
            for i, u in enumerate(raw):
                by_width.setdefault(len(u), []).append(i)
            for width, rows in by_width.items():
                for i, own in zip(rows, cells(_units([raw[i] for i in rows], dtype)), strict=True):
                    listed = own.tobytes()
                    for t in range(TABLES):
                        for p in range(-1, PROBES):  # -1: filed
                            row = (label[i], int(own[t, max(p, 0)]), width, p < 0, node[i], n[i], raw[i], listed, t * PROBES + max(p, 0))
                            for to, value in zip(out, row, strict=True):
                                to.append(value)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=[f.split()[0] for f in FILED.split(", ")])

    return distinct.mapInArrow(run, FILED)


def _first(x: np.ndarray, y: np.ndarray, swap: np.ndarray) -> np.ndarray:
    """The number of the first place where the vectors with cell lists x and y meet.

    Places go by table, then lookups of the smaller id before those of the larger, then probe.
    ``swap`` says where x has the larger id.
    """
    by_x, by_y = y[:, :, :1] == x, x[:, :, :1] == y
    small, large = np.where(swap[:, None, None], by_y, by_x), np.where(swap[:, None, None], by_x, by_y)
    return np.concatenate([small, large], axis=2).reshape(len(x), -1).argmax(axis=1)


def _comparison(dtype: str):
    def compare(table: pa.Table) -> pa.Table:
        filed = table.column("filed").to_numpy(zero_copy_only=False)
        node, n, place = (table.column(c).to_numpy() for c in ("node", "n", "place"))
        unit = _units(table.column("raw").to_pylist(), dtype)
        every = np.stack([np.frombuffer(c, np.int64) for c in table.column("cells").to_pylist()]).reshape(-1, TABLES, PROBES)
        left, right = np.flatnonzero(~filed), np.flatnonzero(filed)
        sums: dict[int, int] = {}
        links: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for a in range(0, len(left), STEP):
            rows = left[a : a + STEP]
            i, j = np.nonzero((unit[rows] @ unit[right].T >= COSINE) & (node[rows][:, None] != node[right][None, :]))
            for c in range(0, len(i), 1 << 16):
                x, y = rows[i[c : c + (1 << 16)]], right[j[c : c + (1 << 16)]]
                t, p = np.divmod(place[x], PROBES)
                swap = node[x] > node[y]
                keep = _first(every[x], every[y], swap) == (2 * t + swap) * PROBES + p
                x, y = x[keep], y[keep]
                links.append((node[x], node[y]))
                held += len(x)
                if held > PAIRS:
                    links, held = [graph.roots(*(np.concatenate([pair[k] for pair in links]) for k in (0, 1)))], 0
                for who, other in ((x, y), (y, x)):
                    ids, at = np.unique(node[who], return_inverse=True)
                    for k, v in zip(ids.tolist(), np.bincount(at, n[other]).astype(np.int64).tolist(), strict=True):
                        sums[k] = sums.get(k, 0) + v
        keys = np.array(sorted(sums), np.int64)
        root = keys
        if len(keys):
            found, low = graph.roots(*(np.concatenate([x[k] for x in links]) for k in (0, 1)))
            root = low[np.searchsorted(found, keys)]
        return pa.table({"node": keys, "links": np.array([sums[k] for k in keys.tolist()], np.int64), "root": root})

    return compare


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row.

    Vectors are compared only where labels are equal and not null.  Null vectors and vectors that are
    empty, zero or hold null or non-finite components link with nothing, nor do rows with a null id;
    vectors of different lengths never link.  Rows of one id are separate vectors in the counts of
    others and share a component.  An empty table gives no rows; further columns are ignored.
    """
    dtype = "<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    flat = common.written(nodes(vectors, id_col, vector_col, label_col, dtype), "vectors")
    distinct = common.written(flat.groupBy("label", "raw").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")).select("node", "label", "n", "raw"), "nodes")
    rows = _filed(distinct, dtype)
    # A cell matters only if two nodes meet in it.  Crowded ones are cut: filed vectors into blocks,
    # lookups into turns, and each block meets each turn.
    cell = ["label", "cell", "width"]
    count = lambda who: F.count(F.when(who, 1))
    crowd = rows.groupBy(*cell).agg(count(F.col("filed")).alias("filed"), count(~F.col("filed")).alias("looked"), F.min("node").alias("low"), F.max("node").alias("high"))
    crowd = common.written(crowd.filter("filed > 0 and low < high").select(*cell, F.ceil(F.col("filed") / BLOCK).alias("blocks"), F.ceil(F.col("looked") / TURN).alias("turns")), "crowds")
    place = lambda total: F.pmod(F.xxhash64("node"), F.col(total))
    every = lambda total: F.sequence(F.lit(0).cast("long"), F.col(total) - 1)
    placed = rows.join(crowd, cell)
    placed = placed.withColumn("block", F.explode(F.when(F.col("filed"), F.array(place("blocks"))).otherwise(every("blocks"))))
    placed = placed.withColumn("turn", F.explode(F.when(F.col("filed"), every("turns")).otherwise(F.array(place("turns"))))).drop("blocks", "turns")
    met = common.written(placed.groupBy(*cell, "block", "turn").applyInArrow(_comparison(dtype), "node long, links long, root long"), "met")
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    # Nodes are ids of distinct vectors; the ids of equal ones hang on them.
    comp = graph.components(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    by_node = distinct.join(counts, "node", "left").join(comp, "node", "left").select("label", "raw", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    found = flat.join(common.written(by_node, "found"), ["label", "raw"]).groupBy("vec_id").agg(F.max(F.col("links") + F.col("n") - 1).alias("n_links"), F.min("root").alias("component_id"))
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    out = given.join(common.written(found, "linked"), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
