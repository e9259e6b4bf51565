"""Passages that occur in several documents: the exchange that two exact operators share.

The question is which fixed-length windows (of bytes or of words) of a document also start in a
document with a smaller id.  Sorting all suffixes of the corpus together would shuffle many times its
size, so documents first agree, by fingerprints, on the few stretches that can repeat at all:

1. Winnowing.  Every window is represented by the smallest hash among its k-grams.  Equal windows
   have equal representatives, and neighbouring windows mostly share theirs, so a document has few.
2. Fingerprints that two documents have go back to their documents, whose windows with such a
   representative form short pieces of text.  Pieces with equal fingerprints meet in one shard.
3. The operator's own index over a shard's pieces finds the windows that start in a smaller document.
4. The spans found go back to their documents.

Of equal fingerprints or pieces in one batch only those of the smallest document are sent on; the
rest are known to repeat then and there.  So the inside of a passage in a third of all documents sends
one row for each batch, not for each document.  At its edges the pieces reach into each document's own
text and all differ; a fingerprint of more than ``HOT`` documents therefore makes no pieces: its
windows are compared one by one, by their digests, in a plain aggregation that no key can fill.  Exact
copies are set apart first, by their digest: every window of all but the smallest of them repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, exchange

#: Bytes of text that are packed together, which bounds a worker's arrays.
PACK_BYTES = 8 << 20
#: Input bytes for each shard of pieces.
SHARD_BYTES = 8 << 20
#: Documents of one fingerprint whose pieces may meet in one shard.
HOT = 4096


@dataclass(frozen=True)
class Unit:
    """What a text is cut into: ``cut`` gives the values of the units, and where each starts and ends.

    ``plain`` maps bytes with equal units to equal bytes.
    """

    cut: Callable[[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]
    window: int
    gram: int
    plain: Callable[[bytes], bytes] = bytes

    @property
    def width(self) -> int:
        """K-grams in a window."""
        return self.window - self.gram + 1


def cut_bytes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(len(text) + 1)
    return np.frombuffer(text, np.uint8), at[:-1], at[1:]


def cut_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    starts, ends = common.word_spans(data)
    return common.span_hash(common.prefix_hash(data), starts, ends), starts, ends


def representatives(values: np.ndarray, unit: Unit) -> np.ndarray:
    """The representative of every window of a sequence of units (none if it is too short)."""
    n = len(values) - unit.gram + 1
    if n < unit.width:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    low = common.span_hash(common.prefix_hash(values), at, at + unit.gram)
    span = 1
    while 2 * span <= unit.width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = unit.width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _all_representatives(texts: list[bytes], unit: Unit) -> list[np.ndarray]:
    """Distinct representatives of each text; short texts are hashed together."""
    return [np.unique(r[np.flatnonzero(np.diff(r, prepend=~r[:1]))]) if len(r) else r for r in (representatives(unit.cut(t)[0], unit) for t in texts)]


def repeated_prints(docs: DataFrame, unit: Unit, n: int) -> DataFrame:
    """(doc_id, print): fingerprints of each document that another document has too, by ``n`` buckets.

    The fingerprints are the 48 low bits; taking two for one costs a look at pieces that differ.
    """

    def prints(batch: pa.RecordBatch) -> Iterator[exchange.Prints]:
        every, whole = common.column(batch, "doc_id").to_pylist(), common.utf8(batch, "text")
        for a, b in common.steps([len(t) for t in whole], PACK_BYTES):
            ids, texts = every[a:b], whole[a:b]
            own = [(i, r) for i, r in zip(ids, _all_representatives(texts, unit), strict=True) if len(r)]
            if own:
                yield np.array([i for i, _ in own], np.int64), np.array([len(r) for _, r in own]), np.concatenate([r for _, r in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, counts, values in prints(batch):
                owner = np.repeat(np.arange(len(ids)), counts)
                order = np.lexsort((ids[owner], values))
                values, owner = values[order], owner[order]
                heads = np.ones(len(values), bool)
                heads[1:] = values[1:] != values[:-1]
                run_of = np.cumsum(heads) - 1
                several = np.bincount(run_of)[run_of] > 1
                # Known here to repeat: all but each run's first, which is sent on as any other.
                back = np.argsort(owner[heads], kind="stable")
                sent = exchange.packed((ids, np.bincount(owner[heads], minlength=len(ids)), values[heads][back]), n)
                known = np.flatnonzero(several)
                spread = (common.mix(ids[owner[known]].astype(np.uint64)) % np.uint64(n)).astype(np.int64)
                by = np.argsort(spread, kind="stable")
                known, spread = known[by], spread[by]
                cuts = np.flatnonzero(np.diff(spread, prepend=-1))
                kept = {int(spread[a]): (ids[owner[known[a:b]]].astype("<i8").tobytes(), (values[known[a:b]] & exchange.LOW).astype("<i8").tobytes()) for a, b in zip(cuts, np.append(cuts, len(spread))[1:], strict=True)}
                buckets = sent.column(0).to_pylist()
                extra = [kept.pop(b, (b"", b"")) for b in buckets]
                out = [*sent.columns, pa.array([e[0] for e in extra], pa.binary()), pa.array([e[1] for e in extra], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=names)
                if kept:
                    empty = pa.array([b""] * len(kept), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), empty, empty, empty, pa.array([e[0] for e in kept.values()], pa.binary()), pa.array([e[1] for e in kept.values()], pa.binary())], names=names)

    def merge(table: pa.Table) -> pa.Table:
        values, ids = exchange.unpacked(table)
        order = np.argsort(values, kind="stable")
        values, ids = values[order], ids[order]
        same = np.zeros(len(values), bool)
        same[1:] = values[1:] == values[:-1]
        same[:-1] |= same[1:]
        ids, values = ids[same], values[same].view(np.int64)
        more = [np.frombuffer(b"".join(table.column(c).to_pylist()), "<i8") for c in ("known_ids", "known")]
        return pa.table({"doc_id": np.concatenate([ids, more[0]]), "print": np.concatenate([values, more[1]])})

    names = ["bucket", "prints", "times", "ids", "known_ids", "known"]
    sent = docs.mapInArrow(run, "bucket long, prints binary, times binary, ids binary, known_ids binary, known binary")
    return sent.groupBy("bucket").applyInArrow(merge, "doc_id long, print long")


PIECES = "shard long, ids binary, starts binary, sizes binary, marks binary, pieces binary, done_ids binary, done_starts binary, done_ends binary"


def _pieces(texts_with_prints: DataFrame, unit: Unit, shards: int) -> DataFrame:
    """Pieces for the shards, and spans already known to repeat, packed by batch and shard.

    ``starts`` and ``done_*`` count units of the document; a piece is the bytes from its first unit
    to the end of its last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, found = common.column(batch, "doc_id").to_pylist(), common.utf8(batch, "text"), common.column(batch, "prints")
            order = np.argsort(np.array(ids, np.int64), kind="stable").tolist()  # the smallest document of equal pieces comes first
            for first_row, last_row in common.steps([len(texts[r]) for r in order], PACK_BYTES):
                yield _packed(*cut(order[first_row:last_row], ids, texts, found), shards)

    def cut(rows: list[int], ids: list[int], texts: list[bytes], found: pa.Array) -> tuple[dict, list]:
        best: dict[tuple[int, bytes], tuple[int, list[int], int]] = {}
        done: list[tuple[int, int, int]] = []
        for row in rows:
            doc_id, text = ids[row], texts[row]
            values, starts, ends = unit.cut(text)
            low = representatives(values, unit)
            if not len(low):
                continue
            prints = np.unique(found[row].values.to_numpy(zero_copy_only=False)).astype(np.uint64)
            key = low & exchange.LOW
            at = np.minimum(np.searchsorted(prints, key), len(prints) - 1)
            hit = prints[at] == key
            # Maximal runs of windows with one representative.
            edge = np.flatnonzero((low[1:] != low[:-1]) | (hit[1:] != hit[:-1])) + 1
            first = np.concatenate([[0], edge])
            last = np.concatenate([edge, [len(low)]]) - 1 + unit.window  # units, exclusive
            keep = hit[first]
            for a, b, mark in zip(first[keep].tolist(), last[keep].tolist(), key[first[keep]].tolist(), strict=True):
                piece = text[starts[a] : ends[b - 1]]
                known = best.setdefault((mark, piece), (doc_id, [], b - a))
                if known[0] == doc_id:
                    known[1].append(a)
                else:
                    done.append((doc_id, a, b))
        return best, done

    return texts_with_prints.mapInArrow(run, PIECES)


WINDOWS = "doc_id long, first long, last long, digest binary"


def _hot_spans(texts_with_prints: DataFrame, unit: Unit) -> DataFrame:
    """(doc_id, first, last) of windows under the given prints that also start in a smaller document.

    Windows are equal if their digests of 128 bits are.  Of equal windows in one batch only those of
    the smallest document are looked up; the others have no digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, found = common.column(batch, "doc_id").to_pylist(), common.utf8(batch, "text"), common.column(batch, "prints")
            order = np.argsort(np.array(ids, np.int64), kind="stable").tolist()
            for first_row, last_row in common.steps([len(texts[r]) for r in order], PACK_BYTES):
                seen: dict[bytes, int] = {}
                out: list[list] = []
                for row in order[first_row:last_row]:
                    doc_id, text = ids[row], texts[row]
                    values, starts, ends = unit.cut(text)
                    hit = np.isin(representatives(values, unit) & exchange.LOW, found[row].values.to_numpy(zero_copy_only=False).astype(np.uint64))
                    open_span = None
                    for a in np.flatnonzero(hit).tolist():
                        digest = hashlib.blake2b(unit.plain(text[starts[a] : ends[a + unit.window - 1]]), digest_size=16).digest()
                        if seen.setdefault(digest, doc_id) == doc_id:
                            out.append([doc_id, a, a + unit.window, digest])
                        elif open_span and a <= open_span[2]:
                            open_span[2] = a + unit.window
                        else:
                            open_span = [doc_id, a, a + unit.window, None]
                            out.append(open_span)
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, [pa.int64()] * 3 + [pa.binary()], strict=True)], names=["doc_id", "first", "last", "digest"])

    windows = common.written(texts_with_prints.mapInArrow(run, WINDOWS), "windows")
    open_ones = windows.filter("digest is not null")
    low = open_ones.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").drop("high")
    return windows.filter("digest is null").drop("digest").union(open_ones.join(low, "digest").filter("doc_id > low").select("doc_id", "first", "last"))


def _packed(best: dict, done: list, shards: int) -> pa.RecordBatch:
    """One row for each shard: its pieces, and the spans that need no shard, spread by document."""
    rows: dict[int, tuple[list, list]] = {}
    for (mark, piece), (doc_id, starts, size) in best.items():
        to = rows.setdefault((mark * 0x9E3779B97F4A7C15 >> 20) % shards, ([], []))[0]
        to.extend((doc_id, start, size, mark, piece) for start in starts)
    for span in done:
        rows.setdefault((span[0] * 0x9E3779B97F4A7C15 >> 20) % shards, ([], []))[1].append(span)
    out: list[list] = [[] for _ in range(9)]
    for shard, (found, known) in rows.items():
        columns = list(zip(*found, strict=True)) or [()] * 5
        numbers = [np.array(c, d).tobytes() for c, d in zip(columns[:4], ("<i8", "<i8", "<i4", "<i8"), strict=True)]
        lengths = np.array([len(p) for p in columns[4]], "<i4").tobytes()
        spans = [np.array(c, "<i8").tobytes() for c in (zip(*known, strict=True) if known else [()] * 3)]
        for to, value in zip(out, (shard, *numbers, len(found).to_bytes(8, "little") + lengths + b"".join(columns[4]), *spans), strict=True):
            to.append(value)
    kinds = [pa.int64()] + [pa.binary()] * 8
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])


def _unpack(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:8], "little")
    ends = np.cumsum(np.frombuffer(blob, "<i4", n, 8)).tolist()
    body = blob[8 + 4 * n :]
    return [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if n else []


#: Distinct pieces of a shard and the smallest document of each, to the spans (piece, first unit, last
#: unit + 1) of windows that also start in a piece of a smaller document.
Index = Callable[[list[bytes], np.ndarray], list[tuple[int, int, int]]]


def repeated_spans(docs: DataFrame, unit: Unit, index: Index) -> DataFrame:
    """(doc_id, text, copy_of, spans): texts with the spans of units to remove.

    ``docs`` has one row for each id.  For exact copies of a text in a smaller document
    ``copy_of`` is that document's id, and ``spans`` is not filled in.
    """
    shards = int(max(4 * common.shuffle_partitions(docs), -(-common.input_bytes(docs) // SHARD_BYTES)))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digests = texts.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.xxhash64("text").alias("check"))
    low = digests.groupBy("digest", "check").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    low = common.written(low, "copied")
    copies = common.written(digests.join(low, ["digest", "check"]).filter("doc_id > copy_of").groupBy("doc_id").agg(F.min("copy_of").alias("copy_of")), "copies")

    def merge(table: pa.Table) -> pa.Table:
        ids, starts, sizes, marks, pieces = [], [], [], [], []
        for a, b, c, m, blob in zip(*(table.column(x).to_pylist() for x in ("ids", "starts", "sizes", "marks", "pieces")), strict=True):
            ids.append(np.frombuffer(a, "<i8"))
            marks.append(np.frombuffer(m, "<i8"))
            starts.append(np.frombuffer(b, "<i8"))
            sizes.append(np.frombuffer(c, "<i4"))
            pieces += _unpack(blob)
        ids, starts, sizes = np.concatenate(ids), np.concatenate(starts), np.concatenate(sizes).astype(np.int64)
        done = [np.frombuffer(b"".join(table.column(x).to_pylist()), "<i8") for x in ("done_ids", "done_starts", "done_ends")]
        # One of equal pieces goes into the index, that of the smallest document; the others repeat whole.
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(p, len(number)) for p in pieces], np.int64)
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids)
        whole = ids > least[which] if len(ids) else np.zeros(0, bool)
        # A piece that is alone under its fingerprint has nothing to share a window with.
        mark = np.zeros(len(number), np.int64)
        mark[which] = np.concatenate(marks)
        _, of, times = np.unique(mark, return_inverse=True, return_counts=True)
        some = np.flatnonzero(times[of] > 1)
        distinct = list(number)
        found = [(int(some[p]), a, b) for p, a, b in index([distinct[i] for i in some], least[some])] if len(some) else []
        out = [np.concatenate([ids[whole], done[0]]), np.concatenate([starts[whole], done[1]]), np.concatenate([(starts + sizes)[whole], done[2]])]
        if found:
            # A document may hold a piece of its own more than once.
            piece, a, b = np.array(found, np.int64).T
            own = np.flatnonzero(~whole)
            own = own[np.argsort(which[own], kind="stable")]
            first = np.searchsorted(which[own], piece)
            last = np.searchsorted(which[own], piece, side="right")
            rows = np.concatenate([own[x:y] for x, y in zip(first, last, strict=True)])
            times = last - first
            out = [np.concatenate([out[0], ids[rows]]), np.concatenate([out[1], starts[rows] + np.repeat(a, times)]), np.concatenate([out[2], starts[rows] + np.repeat(b, times)])]
        return pa.table({"doc_id": out[0], "first": out[1], "last": out[2]})

    fresh = texts.join(copies, "doc_id", "left_anti")
    # The number of buckets follows the scan: sizes that Catalyst gives joined frames mean nothing.
    prints = common.written(repeated_prints(fresh, unit, exchange.buckets(docs)), "prints")
    hot = common.written(prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("print"), "hot")
    some_hot = not hot.isEmpty()
    listed = lambda found: found.groupBy("doc_id").agg(F.collect_list("print").alias("prints"))
    # Texts are shuffled once: this join and the last one read the same exchange.
    packed = _pieces(texts.join(listed(prints.join(hot, "print", "left_anti") if some_hot else prints), "doc_id"), unit, shards)
    spans = packed.groupBy("shard").applyInArrow(merge, "doc_id long, first long, last long")
    if some_hot:
        spans = spans.union(_hot_spans(texts.join(listed(prints.join(hot, "print", "left_semi")), "doc_id"), unit))
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return texts.join(by_doc, "doc_id", "left").join(copies, "doc_id", "left")
