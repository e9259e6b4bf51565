"""Substring dedup over words by prefix-partitioned suffix trees.

The suffixes of a shard's pieces are split by prefix: a group that is too large for memory is split
by its next word, and again, so that prefixes have as many words as their groups need.  Each group
becomes a suffix tree of its own, built level by level over whole arrays: its suffixes in order, and
internal nodes as ranges of them with a depth in words.  A node as deep as the window is a passage
that repeats; its suffixes are the places where it starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats
from .suffix_array import merged

WINDOW, GRAM = 50, 24
#: Suffixes of which one tree is built.
GROUP = 1 << 18


@dataclass
class Tree:
    """Suffixes in order; ``common[i]`` is the depth at which suffix i leaves its neighbour i - 1."""

    suffixes: np.ndarray
    common: np.ndarray

    def deep(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes under the topmost nodes that are at least so deep, two suffixes or more."""
        apart = self.common < depth
        heads = np.flatnonzero(apart)
        ends = np.append(heads, len(apart))[1:]
        keep = ends - heads > 1
        return heads[keep], ends[keep]

    def nodes(self) -> list[tuple[int, int, int]]:
        """All internal nodes as (depth, first suffix, end)."""
        out, stack = [], [(0, 0)]
        for i in range(1, len(self.suffixes) + 1):
            depth, first = int(self.common[i]) if i < len(self.suffixes) else -1, i - 1
            while stack and stack[-1][0] > depth:
                d, first = stack.pop()
                out.append((d, first, i))
            if depth >= 0 and (not stack or stack[-1][0] < depth):
                stack.append((depth, first))
        return sorted(out)


def groups(words: np.ndarray, suffixes: np.ndarray, window: int, limit: int = GROUP) -> Iterator[tuple[np.ndarray, int]]:
    """Suffixes that share a prefix, and its length: at most ``limit`` of them, or a whole window."""
    todo = [(suffixes, 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) <= limit or depth == window:
            yield group, depth
            continue
        by = np.argsort(words[group + depth], kind="stable")
        group = group[by]
        cut = np.flatnonzero(np.diff(words[group + depth], prepend=-1))
        for a, b in zip(cut.tolist(), np.append(cut, len(group))[1:].tolist(), strict=True):
            if b - a > 1:
                todo.append((group[a:b], depth + 1))


def build(words: np.ndarray, group: np.ndarray, depth: int, window: int) -> Tree:
    """The tree of suffixes that share ``depth`` words, down to ``window`` words."""
    order, node = group, np.zeros(len(group), np.int64)
    common_depth = np.full(len(group), window, np.int64)
    common_depth[:1] = 0
    live = np.arange(len(group))  # places of suffixes whose node has others
    for d in range(depth, window):
        if not len(live):
            break
        word = words[order[live] + d]
        by = np.lexsort((word, node[live]))
        order[live], word = order[live[by]], word[by]  # places keep their nodes: those are in order
        split = np.zeros(len(live), bool)
        split[1:] = (node[live[1:]] == node[live[:-1]]) & (word[1:] != word[:-1])
        common_depth[live[split]] = d
        start = split.copy()
        start[0] = True
        start[1:] |= node[live[1:]] != node[live[:-1]]
        fresh = np.cumsum(start)
        node[live] = fresh
        alone = np.bincount(fresh)[fresh] == 1
        live = live[~alone]
    return Tree(order, common_depth)


def index(pieces: list[bytes], least: np.ndarray, *, window: int = WINDOW, limit: int = GROUP) -> list[tuple[int, int, int]]:
    """Spans of words of each piece that windows starting in a piece of a smaller document cover."""
    number: dict[bytes, int] = {}
    cut = [p.split() for p in pieces]
    words = np.array([number.setdefault(w, len(number)) for p in cut for w in p], np.int64)
    sizes = np.array([len(p) for p in cut], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(pieces)), sizes)
    suffixes = np.flatnonzero(np.arange(len(words)) + window <= ends[owner])
    hits = []
    for group, depth in groups(words, suffixes, window, limit):
        tree = build(words, group.copy(), depth, window)
        heads, tails = tree.deep(window)
        if len(heads):
            at = np.concatenate([np.arange(a, b) for a, b in zip(heads, tails, strict=True)])
            of = least[owner[tree.suffixes[at]]]
            size = tails - heads
            low = np.minimum.reduceat(of, np.cumsum(size) - size)
            hits.append(tree.suffixes[at][np.repeat(low, size) < of])
    hit = np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
    if not len(hit):
        return []
    edge = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])))
    first, last = hit[edge], hit[np.append(edge, len(hit))[1:] - 1] + window
    piece = owner[first]
    return list(zip(piece.tolist(), (first - starts[piece]).tolist(), (last - starts[piece]).tolist(), strict=True))


UNIT = repeats.Unit(repeats.cut_words, WINDOW, GRAM, lambda piece: b" ".join(piece.split()))
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the words that a repeated passage of 50 words covers.

    A word goes if 50 consecutive words over it also start, in the same order, in a document with a
    smaller id.  Null and empty texts have no words; texts shorter than a window keep all; rows with
    a null id are returned whole.  Rows of one id should have one text: they do not count against
    each other, and where their texts differ each loses what is found for any of them.  An empty
    table gives no rows; further columns are ignored.
    """
    given = common.documents(docs, id_col, text_col)
    found = repeats.repeated_spans(given.filter("doc_id is not null"), UNIT, index)
    rest = given.filter("doc_id is null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("long").alias("copy_of"), F.lit(None).cast("array<struct<first:long,last:long>>").alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, copy, spans in zip(common.column(batch, "doc_id").to_pylist(), common.utf8(batch, "text"), *(common.column(batch, c).to_pylist() for c in ("copy_of", "spans")), strict=True):
                words = text.split()
                n = len(words)
                gone = merged([(s["first"], s["last"]) for s in spans or []], n) if copy is None else [(0, n)] * (n >= WINDOW)
                edges = [0, *[x for s in gone for x in s], n]
                kept = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
                joined = b" ".join(kept)
                rows.append((doc_id, n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return found.select("doc_id", "text", "copy_of", "spans").union(rest).mapInArrow(run, SCHEMA)
