"""Suffix-array dedup: repeated byte strings found by external induced sorting.

Suffixes of a shard's text are sorted by induction: the sorted suffixes that start at a local minimum
(the left-most S positions) induce the L suffixes in one ascending pass, and these the S suffixes in a
descending one.  A pass takes suffix tuples (position, common prefix with the one before) from a
monotone priority queue: one first-in-first-out list for each first character, on disk beyond a bound,
with a heap over the characters in use.  Whole lists are taken and induced at once.  Common-prefix
values travel with the tuples: an induced neighbour pair shares one character more than the least
value between its parents.  The local minima are sorted recursively, by names of the substrings
between them, until they fit a direct sort in memory.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, repeats

WINDOW, GRAM = 50, 28
#: Tuples a queue holds in memory, and local minima that are sorted directly.
QUEUE_TUPLES, DIRECT = 1 << 22, 1 << 20
INF = np.int64(1) << 40


class BucketQueue:
    """A priority queue of (first character, position, common prefix) for bulk use; equal keys in order."""

    def __init__(self, limit: int = QUEUE_TUPLES, descending: bool = False):
        self.lists: dict[int, list] = {}
        self.heap: list[int] = []
        self.sign, self.limit, self.held, self.file, self.at = -1 if descending else 1, limit, 0, None, 0

    def push(self, key: int, position: np.ndarray, prefix: np.ndarray) -> None:
        if key not in self.lists:
            self.lists[key] = []
            heapq.heappush(self.heap, self.sign * key)
        self.lists[key].append((position, prefix))
        self.held += len(position)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        """All lists go to one file, which has no name and ends with the queue."""
        self.file = self.file or tempfile.TemporaryFile()
        for parts in self.lists.values():
            for i, part in enumerate(parts):
                if len(part) == 2:
                    self.file.seek(self.at)
                    self.file.write(part[0].astype(np.int64).tobytes() + part[1].astype(np.int64).tobytes())
                    parts[i] = (self.at, len(part[0]), None)
                    self.at += 16 * len(part[0])
        self.held = 0

    def key(self) -> int | None:
        return self.sign * self.heap[0] if self.heap else None

    def pop(self, key: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The whole list of ``key`` if it has one; keys are asked for in the queue's order."""
        parts = self.lists.pop(key, None)
        if parts is None:
            return None
        while self.heap and self.heap[0] == self.sign * key:
            heapq.heappop(self.heap)
        whole = []
        for part in parts:
            if len(part) == 3:
                self.file.seek(part[0])
                raw = np.frombuffer(self.file.read(16 * part[1]), np.int64)
                whole.append((raw[: part[1]], raw[part[1] :]))
            else:
                self.held -= len(part[0])
                whole.append(part)
        return np.concatenate([p for p, _ in whole]), np.concatenate([x for _, x in whole])


class _Pass:
    """One inducing pass: sends the predecessors of a run of sorted suffixes to their queues."""

    def __init__(self, text: np.ndarray, queue: BucketQueue):
        self.text, self.queue = text, queue
        self.least: dict[int, int] = {}  # of a key: the least common prefix since its last push
        self.past = INF  # ... of all runs since a key's entry was brought up to date
        self.log: list[int] = []
        self.seen: dict[int, int] = {}

    def _since(self, key: int) -> int:
        """Least common prefix over the runs sent after the key's last push."""
        rest = self.log[self.seen[key] :]
        return min([self.least[key], *rest])

    def send(self, position: np.ndarray, prefix: np.ndarray, admit: np.ndarray) -> None:
        """``position`` in processing order; ``admit`` marks those whose predecessor is induced."""
        at = np.flatnonzero(admit)
        if len(at):
            before = position[at] - 1
            chars = self.text[before]
            order = np.argsort(chars, kind="stable")
            at, before, chars = at[order], before[order], chars[order]
            heads = np.flatnonzero(np.diff(chars, prepend=chars[0] - 1))
            ends = np.append(heads, len(chars))[1:]
            # Least value between consecutive parents of one key, both ends as in (previous, own].
            low = np.empty(len(at) + 1, np.int64)
            low[1:] = at + 1
            low[0] = 0
            start = low[:-1].copy()
            start[heads] = 0
            pairs = np.empty(2 * len(at), np.int64)
            pairs[0::2], pairs[1::2] = start, at + 1
            value = np.minimum.reduceat(np.append(prefix, INF), pairs)[0::2] + 1
            tail = np.minimum.accumulate(np.append(prefix, INF)[::-1])[::-1]
            for h, e, c in zip(heads.tolist(), ends.tolist(), chars[heads].tolist(), strict=True):
                own = value[h:e]
                if c in self.seen:
                    own[0] = min(own[0], 1 + self._since(c))
                else:
                    own[0] = 0  # the first suffix with this character
                self.queue.push(c, before[h:e], own)
                self.least[c], self.seen[c] = int(tail[at[e - 1] + 1]), len(self.log) + 1
        self.log.append(int(prefix.min()) if len(prefix) else int(INF))
        if len(self.log) > 4096:
            for c in self.seen:
                self.least[c], self.seen[c] = self._since(c), 0
            self.log.clear()


def _runs(text: np.ndarray) -> np.ndarray:
    """How often each position's character repeats from there on."""
    ends = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    return ends[np.searchsorted(ends, np.arange(len(text)))] - np.arange(len(text)) + 1


def induce(text: np.ndarray, s_type: np.ndarray, minima: np.ndarray, prefix: np.ndarray, limit: int = QUEUE_TUPLES) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes sorted, with common prefixes, from the local minima in order (and theirs)."""
    runs = _runs(text)
    first = text[minima]
    heads = np.flatnonzero(np.diff(first, prepend=first[:1] - 1))
    seeds = {int(first[a]): (a, b) for a, b in zip(heads, np.append(heads, len(first))[1:], strict=True)}
    queue = BucketQueue(limit)
    ascend = _Pass(text, queue)
    keys = sorted(seeds)
    lower: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    while keys or queue.key() is not None:
        c = min(x for x in (keys[0] if keys else None, queue.key()) if x is not None)
        waves = []
        while (wave := queue.pop(c)) is not None:
            position, common_prefix = wave
            ok = position > 0
            ok[ok] = text[position[ok] - 1] >= c
            waves.append(wave)
            ascend.send(position, common_prefix, ok)
        if waves:
            lower[c] = (np.concatenate([p for p, _ in waves]), np.concatenate([x for _, x in waves]))
        if keys and keys[0] == c:
            keys.pop(0)
            a, b = seeds[c]
            position, own = minima[a:b], prefix[a:b].copy()
            own[0] = min(runs[lower[c][0][-1]], runs[position[0]]) if c in lower else 0
            ok = position > 0
            ok[ok] = text[position[ok] - 1] > c
            ascend.send(position, own, ok)
    queue = BucketQueue(limit, descending=True)
    descend = _Pass(text, queue)
    upper: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    keys = sorted(lower, reverse=True)
    while keys or queue.key() is not None:
        c = max(x for x in (keys[0] if keys else None, queue.key()) if x is not None)
        waves = []
        while (wave := queue.pop(c)) is not None:
            position, common_prefix = wave
            ok = position > 0
            ok[ok] = text[position[ok] - 1] <= c
            waves.append(wave)
            descend.send(position, common_prefix, ok)
        if waves:
            upper[c] = (np.concatenate([p for p, _ in waves]), np.concatenate([x for _, x in waves]))
        if keys and keys[0] == c:
            keys.pop(0)
            position, own = lower[c]
            position = position[::-1]
            # Each value now belongs to the larger suffix's smaller neighbour.
            own = np.append(0, own[:0:-1])
            own[0] = min(runs[upper[c][0][-1]], runs[position[0]]) if c in upper else 0
            ok = position > 0
            ok[ok] = text[position[ok] - 1] < c
            descend.send(position, own, ok)
    order, values = [], []
    # The sentinel, the one S suffix that nothing induces, comes first.
    if (last := len(text) - 1) >= 0:
        order.append(np.array([last]))
        values.append(np.zeros(1, np.int64))
    for c in sorted({*lower, *upper}):
        if c in lower:
            order.append(lower[c][0])
            values.append(lower[c][1])
        if c in upper:
            position, own = upper[c]
            seam = min(runs[lower[c][0][-1]], runs[position[-1]]) if c in lower else 0
            order.append(position[::-1])
            values.append(np.append(seam, own[:0:-1]))
    return np.concatenate(order), np.concatenate(values)


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the sentinel counts as such."""
    step = np.sign(np.diff(text.astype(np.int64)))
    # A run takes the type of its last step.
    where = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(where[::-1])[::-1]
    return np.append(np.append(step, -1)[following] > 0, True)


def _words(text: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """At every position the next eight characters as one number, or one character of a large alphabet."""
    pad = np.concatenate([text, np.zeros(depth + 8, text.dtype)])
    if len(text) and text.max() > 255:
        return pad.astype(np.uint64), 1
    word = np.zeros(len(text) + depth, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | pad[k : k + len(word)].astype(np.uint64)
    return word, 8


def _direct(text: np.ndarray, minima: np.ndarray, depth: int) -> np.ndarray:
    """The minima sorted by their first ``depth`` characters or some more."""
    word, width = _words(text, depth)
    return minima[np.lexsort([word[minima + k] for k in range(0, depth, width)][::-1])]


def _common(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of neighbours, exact up to ``depth`` characters."""
    word, width = _words(text, depth)
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for k in range(0, depth, width):
        differ = word[order[live] + k] ^ word[order[live - 1] + k]
        end = differ != 0
        # Equal leading bytes of the first word that differs.
        at = differ[end]
        same = np.zeros(len(at), np.int64)
        for i in range(1, width):
            same += at >> np.uint64(8 * (width - i)) == 0
        out[live[end]] = k + same
        live = live[~end]
        out[live] = k + width
        if not len(live):
            break
    return out


def suffix_array(text: np.ndarray, depth: int, *, direct: int = DIRECT, limit: int = QUEUE_TUPLES) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and common prefixes with the one before.

    ``text`` are integers, the last one a sentinel below all others.  Suffixes equal in their first
    ``depth`` characters may come in any order; values up to ``depth`` are exact, larger ones are at
    least ``depth``.
    """
    s_type = _types(text)
    minima = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if not len(minima):
        minima = np.array([len(text) - 1])
    if len(minima) <= direct:
        order = _direct(text, minima, depth)
    else:
        # Substrings between minima are sorted by the same two passes, from the minima unsorted.
        seeded = minima[np.argsort(text[minima], kind="stable")]
        rough, _ = induce(text, s_type, seeded, np.zeros(len(seeded), np.int64), limit)
        is_minimum = np.zeros(len(text), bool)
        is_minimum[minima] = True
        rough = rough[is_minimum[rough]]
        length = np.append(np.diff(minima), 0)[np.searchsorted(minima, rough)]
        name = np.zeros(len(rough), np.int64)
        pad = np.append(text, np.zeros(int(length.max()) + 2, text.dtype))
        same = length[1:] == length[:-1]
        for k in range(int(length.max()) + 1):
            live = np.flatnonzero(same & (k <= length[1:]))
            if not len(live):
                break
            same[live] = pad[rough[live + 1] + k] == pad[rough[live] + k]
        name[1:] = np.cumsum(~same)
        reduced = np.empty(len(minima), np.int64)
        reduced[np.searchsorted(minima, rough)] = name
        if name[-1] + 1 == len(name):
            order = rough
        else:
            order = minima[suffix_array(reduced, depth, direct=direct, limit=limit)[0]]
    return induce(text, s_type, order, _common(text, order, depth), limit)


def index(pieces: list[bytes], least: np.ndarray, *, window: int = WINDOW, direct: int = DIRECT, limit: int = QUEUE_TUPLES) -> list[tuple[int, int, int]]:
    """Spans of each piece that windows starting in a piece of a smaller document cover."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    raw = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    # 0 the sentinel, 1 the end of a piece, then the bytes that occur.
    code = np.cumsum(np.bincount(raw, minlength=256) > 0).astype(np.int16) + np.int16(1)
    text = code[raw]
    text[ends - 1] = 1
    text = np.append(text, np.int16(0))
    order, prefix = suffix_array(text, window, direct=direct, limit=limit)
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    inside = np.append(np.arange(len(owner)) + window < ends[owner], False)  # the window ends inside the piece
    keep = inside[order]
    # A class of equal windows: neighbours with a common prefix of a whole window.  Suffixes too short
    # for a window cannot stand between two of a class.
    position, fresh = order[keep], (prefix < window)[keep]
    if not len(position):
        return []
    fresh[0] = True
    heads = np.flatnonzero(fresh)
    low = np.minimum.reduceat(least[owner[position]], heads)
    low = np.repeat(low, np.diff(np.append(heads, len(position))))
    hit = np.sort(position[low < least[owner[position]]])
    if not len(hit):
        return []
    cut = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])))
    first, last = hit[cut], hit[np.append(cut, len(hit))[1:] - 1] + window
    piece = owner[first]
    return list(zip(piece.tolist(), (first - starts[piece]).tolist(), (last - starts[piece]).tolist(), strict=True))


UNIT = repeats.Unit(repeats.cut_bytes, WINDOW, GRAM)
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Disjoint spans in order, clipped to the text; touching ones are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        a, b = max(0, a), min(b, size)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif a < b:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the bytes that a repeated 50-byte string covers.

    A byte goes if a 50-byte string over it also starts in a document with a smaller id.  Null and
    empty texts, and texts shorter than a window, keep all; rows with a null id are returned whole.
    Rows of one id should have one text: they do not count against each other, and where their texts
    differ each loses what is found for any of them.  An empty table gives no rows; further columns
    are ignored.
    """
    given = common.documents(docs, id_col, text_col)
    found = repeats.repeated_spans(given.filter("doc_id is not null"), UNIT, index)
    rest = given.filter("doc_id is null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("long").alias("copy_of"), F.lit(None).cast("array<struct<first:long,last:long>>").alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, copy, spans in zip(common.column(batch, "doc_id").to_pylist(), common.utf8(batch, "text"), *(common.column(batch, c).to_pylist() for c in ("copy_of", "spans")), strict=True):
                n = len(text)
                gone = merged([(s["first"], s["last"]) for s in spans or []], n) if copy is None else [(0, n)] * (n >= WINDOW)
                edges = [0, *[x for s in gone for x in s], n]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((doc_id, n, n - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return found.select("doc_id", "text", "copy_of", "spans").union(rest).mapInArrow(run, SCHEMA)
